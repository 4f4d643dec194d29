import hashlib

from quern.llm.exact_dedup import deduplicate, duplicate_groups

SCHEMA = "doc_id long, text string, keep_id string, content string"


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        c = "".join(x for x in (t or "") if x not in " \t\n\x0b\f\r")
        groups.setdefault(c, []).append((i, t or ""))
    out = []
    for c, g in groups.items():
        keep = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))[0]
        out += [(i, keep, len(g), i == keep, hashlib.sha256(c.encode()).hexdigest()) for i, _ in g]
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rows = [(1, "a b", "x", None), (2, "ab", "y", "z"), (3, "a\tb ", None, None), (4, None, "", ""), (5, " \n", "", ""), (6, "é é", "", ""), (-7, "éé ", "", ""), (8, "é é", "", ""), (9, "q" * 100000, "", ""), (10, "q" * 100000, "", ""), (None, "ab  ", "", ""), (10, "q" * 100000, "", "")]
    got = sorted((tuple(r) for r in duplicate_groups(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(rows)
    kept = deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "keep_id", "content"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-7, 3, 5, 8, 9]  # the space in text 8 is a no-break space, which stays


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "ab", "x", "1"), (1, "ab", "y", "2"), (2, "a b ", "z", "3"), (2, "a b ", "z", "3"), (None, "q", "", "4"), (None, " q", "", "5"), (3, "c", None, None)]
    kept = deduplicate(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "keep_id", "content"]
    assert {r.doc_id for r in kept.collect()} == {2, 3, None}
    assert sorted(r.text.replace(" ", "") for r in kept.collect()) == ["ab", "c", "q"]


def test_empty(spark):
    assert duplicate_groups(spark.createDataFrame([], SCHEMA)).count() == 0
