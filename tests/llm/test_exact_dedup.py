import hashlib
import re
from collections import defaultdict

import pytest

from brindle.llm.exact_dedup import exact_dedup

from .conftest import by_row


def brute(corpus):
    groups = defaultdict(list)
    for doc_id, text, *_ in corpus:
        groups[re.sub(r"[\x20\x09-\x0d]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = min(known) if known else None, True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


@pytest.mark.parametrize("frame", ["docs", "clashing"])
def test_like_brute_force(frame, corpus, request):
    assert by_row(exact_dedup(request.getfixturevalue(frame), all_digests=True)) == brute(corpus)


def test_digests_of_survivors_alone(docs, corpus):
    found, whole = by_row(exact_dedup(docs)), brute(corpus)
    assert [r[:4] for r in found] == [r[:4] for r in whole]
    assert all(a[4] in (None, b[4]) for a, b in zip(found, whole, strict=True))
    assert any(r[4] is None for r in found) and all(r[4] for r in found if r[2] > 1)


def test_empty(empty):
    assert exact_dedup(empty).collect() == []
