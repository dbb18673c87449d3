"""The registered queries of this package, each over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablework.llm import common as C
from tablework.llm import (
    decontamination,
    exact,
    language,
    licenses,
    lines,
    merkle,
    minhash,
    ngramjoin,
    packing,
    scoring,
    suffixes,
    urls,
    whitening,
)
from tablework.sources.files import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            C.ready(spark)
            return function(spark, folder)

        QUERIES[function.__name__] = run
        if oracle is not None:
            ORACLE[function.__name__] = oracle
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder.rstrip('/')}/{name}.parquet")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@query(
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
        lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT size FROM bw),
    dw AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM d, sizes WHERE len(w) >= size),
    hit AS (SELECT DISTINCT doc_id, i, size, item_id FROM (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
        FROM dw) JOIN bw USING (size, win)),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""
)
def op1_decontamination(spark, folder):
    judged = decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.col("items").cast("array<string>")))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op2_licenses(spark, folder):
    found = licenses.scanned(table(spark, folder, "documents"))
    return found.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query(
    r"""WITH p AS (SELECT page_id, lower(regexp_extract(split_part(url, '://', 2), '^[^/?#]*')) AS host,
        list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''),
            '(?is)<script\b.*?</script>|<style\b.*?</style>', chr(10), 'g'), '(?s)<!--.*?-->|<[^>]*>', chr(10), 'g'), chr(10)),
            lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x != '') AS lines FROM pages),
    sites AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
    lines AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY ALL),
    gone AS (SELECT host, list(line) AS common FROM lines JOIN sites USING (host)
        WHERE host_pages >= 3 AND n > 0.5 * host_pages GROUP BY host),
    k AS (SELECT page_id, host, host_pages, lines, list_filter(lines, lambda x: common IS NULL OR NOT list_contains(common, x))
        AS kept FROM p JOIN sites USING (host) LEFT JOIN gone USING (host))
    SELECT page_id, host, host_pages, len(lines) AS n_lines, len(kept) AS n_kept, array_to_string(kept, chr(10)) AS text FROM k"""
)
def op3_site_lines(spark, folder):
    pages = urls.with_parts(table(spark, folder, "pages").select("page_id", "url", "html"), F.col("url"))
    found = lines.without_boilerplate(pages, lines.page_lines(F.col("html")), F.col("host"))
    return found.withColumn("text", F.array_join("kept", "\n")).drop("kept")


@query()
def op4_mixing_scores(spark, folder):
    return scoring.scores(table(spark, folder, "documents"))


@query()
def op5_repeats(spark, folder):
    return suffixes.without_repeats(table(spark, folder, "documents"))


@query()
def op6_packing(spark, folder):
    import public_tokenizers

    return packing.packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query(
    r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
        text_sha256 FROM d WINDOW g AS (PARTITION BY text_sha256)"""
)
def op7_exact_dedup(spark, folder):
    return exact.copies(table(spark, folder, "documents")).drop("row")


# The rules of the registered query.
URL_RULES = [
    (urls.ALLOW, "com/"),
    (urls.BLOCK, "example.com/en/"),
    (urls.ALLOW, "www.example.com/en/"),
    (urls.BLOCK, "net/es/"),
    (urls.BLOCK, "net/fr/"),
]


@query()
def op8_urls(spark, folder):
    return urls.filtered(table(spark, folder, "pages"), urls.rule_table(spark, URL_RULES))


@query()
def op9_minhash(spark, folder):
    return minhash.near_copies(table(spark, folder, "documents"), width=4).drop("row", "best")


@query()
def op10_language(spark, folder):
    docs = table(spark, folder, "documents")
    held = language.held_out(F.col("doc_id"), 4, 2)
    model = language.fit(docs.filter(F.col("doc_id").isNotNull() & ~held))
    judged = language.languages(docs, model)
    return judged.select("doc_id", language.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


_LOWERED_TEXT = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_FIELD_SQL = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _manifest_sql(levels: int = 7, top_levels: int = 3) -> str:
    """The manifest, its proofs and the folding, level by level, for up to ``8 ** levels`` rows a language."""
    leaf = "sha256(" + " || ".join(_FIELD_SQL.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(1, len(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))), "
    crc += "lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: " + _CRC_STEP.format("x") + "))"
    depth = lambda most: " + ".join(f"CAST(n > {8**k} AS INTEGER)" for k in range(most))
    steps = [
        "docs AS (SELECT *, CAST(doc_id AS VARCHAR) AS s FROM documents)",
        f"marked AS (SELECT *, coalesce(xor({crc}, 4294967295) % 3 = 0, false) AS tampered FROM docs)",
        f"leaves AS (SELECT doc_id, lang, {leaf.format('text')} AS leaf, CASE WHEN tampered THEN {leaf.format(_LOWERED_TEXT)} "
        f"ELSE {leaf.format('text')} END AS shown FROM marked)",
        "t0 AS (SELECT *, leaf AS d, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, "
        "count(*) OVER (PARTITION BY lang) AS n FROM leaves)",
        f"l0 AS (SELECT *, {depth(levels)} AS depth, shown AS fold, '' AS path FROM t0)",
    ]

    def build(kind: str, tree: str, most: int) -> None:
        for k in range(1, most + 1):
            below = f"{kind}{k - 1}"
            steps.append(
                f"{kind}{k} AS (SELECT {tree}, depth, idx // 8 AS idx, list(d ORDER BY idx) AS run, "
                f"sha256(string_agg(d, '' ORDER BY idx)) AS d FROM {below} WHERE depth >= {k} GROUP BY {tree}, depth, idx // 8)"
            )
        tops = " UNION ALL ".join(f"SELECT {tree}, d FROM {kind}{k} WHERE depth = {k}" for k in range(most + 1))
        steps.append(f"{kind}top AS ({tops})")

    def climb(kind: str, rows: str, tree: str, most: int) -> str:
        for k in range(1, most + 1):
            place = f"CAST(idx_{kind} // {8 ** (k - 1)} % 8 AS INTEGER)"
            left, right = f"array_to_string(run[1:{place}], '')", f"array_to_string(run[{place} + 2:8], '')"
            steps.append(
                f"{rows}{k} AS (SELECT a.* REPLACE (CASE WHEN run IS NULL THEN fold ELSE sha256({left} || fold || {right}) END "
                f"AS fold, CASE WHEN run IS NULL THEN path ELSE path || {left} || {right} END AS path) FROM {rows}{k - 1} a "
                f"LEFT JOIN (SELECT {tree} AS run_tree, idx AS run_idx, run FROM {kind}{k}) ON run_tree IS NOT DISTINCT FROM {tree} "
                f"AND run_idx = idx_{kind} // {8**k})"
            )
        return f"{rows}{most}"

    build("l", "lang", levels)
    steps.append("u AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM ltop)")
    steps.append(f"g0 AS (SELECT lang, 0 AS one, d, idx, {depth(top_levels)} AS depth FROM u)")
    build("g", "one", top_levels)
    steps.append("a0 AS (SELECT doc_id, leaf, lang, 0 AS one, fold, path, idx AS idx_l FROM l0)")
    last = climb("l", "a", "lang", levels)
    steps.append(
        f"b0 AS (SELECT a.*, g.d AS subroot, g.idx AS idx_g FROM {last} a JOIN g0 g ON g.lang IS NOT DISTINCT FROM a.lang)"
    )
    last = climb("g", "b", "one", top_levels)
    return (
        f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, gtop.d AS root, sha256(path) AS proof_sha256, "
        f"fold AS folded_root, fold = gtop.d AS verified FROM {last} CROSS JOIN gtop"
    )


@query(_manifest_sql())
def op11_manifest(spark, folder):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.verified(table(spark, folder, "documents"), merkle.lowered_if(F.col("text"), tampered))


@query()
def op12_whitening(spark, folder):
    return whitening.whitened(table(spark, folder, "embeddings"))


@query()
def op13_ngram_join(spark, folder):
    return ngramjoin.linked(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")
