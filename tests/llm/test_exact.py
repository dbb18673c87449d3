import hashlib
import re
from collections import defaultdict

from tablework.llm import exact
from tests.llm.conftest import odd_rows


def plain(text):
    return re.sub("[ \t-\r]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(i)
    return groups


def check(found, rows):
    groups = expected(rows)
    assert len(found) == len(rows)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(list)
    for r in found:
        ids = by_hash[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        assert r["keep_id"] == (min(named) if named else None)
        assert r["group_size"] == len(ids)
        if r["kept"]:
            kept[r["text_sha256"]].append(r["doc_id"])
    assert {h: [min((i for i in ids if i is not None), default=None)] for h, ids in by_hash.items()} == kept


def test_odd_rows(frame):
    check(exact.copies(frame(odd_rows())).collect(), odd_rows())


def test_heavy_and_light_copies(frame):
    rows = [(i, "heavy one") for i in range(300)] + [(1000 - i, f"light {i // 2}") for i in range(300)]
    check(exact.copies(frame(rows)).collect(), rows)


def test_rows_that_stay_are_as_they_were(frame):
    rows = odd_rows()
    kept = exact.deduplicated(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(plain(r["text"]) for r in kept.collect()) == sorted(expected(rows))


def test_empty_table(frame):
    assert exact.copies(frame([])).collect() == []
    assert exact.deduplicated(frame([])).collect() == []
