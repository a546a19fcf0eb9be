"""Which rows a reader sees: published or draft ones, and those of a locale."""

from __future__ import annotations

from brindle.plans import ir
from brindle.sources.catalog import Module

DEFAULT_LOCALE = "en"


def visible(module: Module, status: str | None, locale: str | None, default_locale: str = DEFAULT_LOCALE) -> ir.Filter | None:
    """Selectors do nothing on modules without the option."""
    parts: list[ir.Filter] = []
    if module.draft_and_publish:
        parts.append(ir.Leaf("published_at", "null" if status == "draft" else "notNull"))
    if module.i18n and locale != "*":
        parts.append(ir.Leaf("locale", "eq", locale or default_locale))
    return ir.all_of(*parts)
