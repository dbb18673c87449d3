from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tablework.llm import lines
from tests.llm.conftest import odd_rows


def brute(pages):
    hosts, seen = Counter(), defaultdict(Counter)
    split = []
    for name, host, text in pages:
        own = [x.strip(" \t\r\v\f") for x in (text or "").split("\n")]
        own = [x for x in own if x]
        host = host or ""
        split.append((name, host, own))
        if host:
            hosts[host] += 1
            seen[host].update(set(own))
    out = []
    for name, host, own in split:
        n = hosts[host]
        kept = [x for x in own if not (host and n >= 3 and seen[host][x] > 0.5 * n)]
        out.append((name, host, n, len(own), tuple(kept)))
    return sorted(out, key=str)


def check(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, site string, text string").withColumn("lines", F.lit("clash"))
    found = lines.without_boilerplate(df, lines.text_lines(F.col("text")), F.col("site")).collect()
    assert sorted(((r["page_id"], r["host"], r["host_pages"], r["n_lines"], tuple(r["kept"])) for r in found), key=str) == brute(pages)
    assert all(r["n_kept"] == len(r["kept"]) for r in found)


def test_ratio_and_small_sites(spark):
    pages = [(i, "a", f"menu\nown {i}\n  menu \nhalf\n" if i % 2 else f"menu\nown {i}\n\t\n") for i in range(10)]
    pages += [(20, "b", "only\npage"), (21, "c", "two\nx"), (22, "c", "two"), (23, None, "menu"), (24, "", "menu"), (25, "a", None)]
    check(spark, pages + [(0, "a", "menu\nown 0"), (0, "a", "menu\nown 0")])


def test_odd_rows_and_empty_table(spark):
    check(spark, [(i, "h" if n % 3 else None, t) for n, (i, t) in enumerate(odd_rows())])
    check(spark, [])


def test_page_lines(spark):
    html = "<head><style>p{}</style><SCRIPT>var t='</p>';\nx</SCRIPT></head><p>one<b> two</b></p><!-- a > b -->three\n\n four "
    df = spark.createDataFrame([(html,), (None,)], "html string").select(lines.page_lines(F.col("html")).alias("l"))
    assert [r["l"] for r in df.collect()] == [["one", "two", "three", "four"], []]


def test_a_line_of_many_blanks(spark):
    text = "a" + " " * 2_000_000 + "b \t\n" + " \x0b\f" * 300_000 + "\n c\r\n"
    df = spark.createDataFrame([(text,)], "text string").select(lines.text_lines(F.col("text")).alias("l"))
    assert df.first()["l"] == ["a" + " " * 2_000_000 + "b", "c"]
