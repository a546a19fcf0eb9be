"""Signed cursors: where a page ended, bound to the query that they came from."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from decimal import Decimal
from typing import Any

from brindle.functions import values as V
from brindle.plans.ir import Filter, QueryError, SortKey
from brindle.plans.parse import canonical

LONGEST, MAC = 8192, 32


class CursorCodec:
    """A token is the base64url of a MAC and a body. The MAC is over the body and the query's module, its version,
    sort and filter; any fault gives the same error, so that nothing is learned by trying."""

    def __init__(self, secret: bytes | str):
        self.secret = secret.encode() if isinstance(secret, str) else secret

    def _mac(self, body: bytes, module: str, version: int, sort: tuple[SortKey, ...], where: Filter | None) -> bytes:
        context = json.dumps([module, version, [[s.field, s.desc] for s in sort], canonical(where)]).encode()
        return hmac.digest(self.secret, len(context).to_bytes(8) + context + body, hashlib.sha256)

    def encode(self, values: list[Any], row_id: int, *context: Any) -> str:
        plain = [str(v) if isinstance(v, Decimal) else V.epoch_ms(v) if hasattr(v, "isoformat") else v for v in values]
        body = json.dumps([1, plain, row_id]).encode()
        return base64.urlsafe_b64encode(self._mac(body, *context) + body).rstrip(b"=").decode()

    def decode(self, token: str, *context: Any) -> tuple[list[Any], int]:
        try:
            if len(token) > LONGEST:
                raise ValueError
            raw = base64.b64decode(token.encode("ascii") + b"=" * (-len(token) % 4), b"-_", validate=True)
            body = raw[MAC:]
            if not hmac.compare_digest(raw[:MAC], self._mac(body, *context)):
                raise ValueError
            version, values, row_id = json.loads(body)
            if version != 1:
                raise ValueError
        except ValueError as e:
            raise QueryError("invalid cursor") from e
        return values, row_id
