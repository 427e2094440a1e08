"""How the fixture tables stand in for papers, chunks, hits, claims and calls.

Each base is a piece of SQL that Spark and DuckDB both run; tables stand in braces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

BASES = {
    "papers": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('arxiv:', doc_id) WHEN doc_id % 3 = 1 THEN concat('s2:', doc_id) ELSE concat('local:', doc_id) END AS paper_id,
        CASE WHEN doc_id % 3 = 0 THEN 'arxiv' WHEN doc_id % 3 = 1 THEN 's2' ELSE 'local' END AS source, CASE WHEN doc_id % 3 = 0 THEN concat('2101.', doc_id) END AS arxiv_id,
        CASE WHEN doc_id % 3 = 1 THEN concat('x', doc_id) END AS s2_paper_id, CASE WHEN doc_id % 2 = 0 THEN concat('10.1/', doc_id) END AS doi, substr(text, 1, 30) AS title, text,
        CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1990 + doc_id % 30 END AS year, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 120 END AS citation_count,
        CASE WHEN doc_id % 6 = 0 OR doc_id % 4 = 0 THEN NULL ELSE doc_id % 9 END AS influential_count, CASE WHEN doc_id % 7 = 0 THEN source WHEN doc_id % 7 = 1 THEN ' ' END AS venue,
        CASE WHEN doc_id % 4 = 0 THEN '[]' WHEN doc_id % 4 = 1 THEN NULL ELSE '["A B"]' END AS authors FROM {documents}""",
    "lanes": """SELECT * FROM (SELECT l_suppkey AS query_id, l_linenumber % 3 AS lane, CAST(row_number() OVER (PARTITION BY l_suppkey, l_linenumber % 3 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INT) AS rank,
        CASE WHEN l_linenumber % 3 = 2 THEN 's2' ELSE 'arxiv' END AS source_type, concat('p', l_partkey % 40) AS source_id, concat('t', l_orderkey) AS title FROM {lineitem}) x WHERE rank <= 20""",
    "hits": "SELECT o_custkey AS query_id, concat('s', o_orderkey % 7) AS source_id, (o_orderkey % 11) / 10.0 AS relevance FROM {orders}",
    "log": """SELECT concat('p', o_custkey) AS paper_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_orderstatus AS source, CASE WHEN o_orderkey % 3 = 0 THEN concat('a', o_orderkey) END AS arxiv_id,
        CASE WHEN o_orderkey % 5 = 0 THEN concat('d', o_orderkey) END AS doi, CASE WHEN o_orderkey % 4 = 0 THEN concat('x', o_orderkey) END AS s2_paper_id, CASE WHEN o_orderkey % 3 = 1 THEN '  ' ELSE concat('T', o_orderkey) END AS title,
        CASE WHEN o_orderkey % 4 = 1 THEN ' ' WHEN o_orderkey % 4 = 2 THEN NULL ELSE concat(' A', o_orderkey, ' ') END AS abstract, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE concat('u', o_orderkey) END AS url,
        CASE WHEN o_orderkey % 6 = 0 THEN 2000 + o_orderkey % 20 END AS year, CASE WHEN o_orderkey % 3 = 0 THEN '[]' WHEN o_orderkey % 3 = 1 THEN NULL ELSE concat('["', o_orderkey, '"]') END AS authors,
        CASE WHEN o_orderkey % 5 = 1 THEN o_orderkey % 90 END AS citation_count, concat('f', o_orderkey) AS fetched_at FROM {orders}""",
    "claims": """SELECT o_orderkey AS claim_id, o_custkey AS run_id, concat('claim of order ', o_orderkey, ' by customer ', o_custkey) AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'consensus' WHEN o_orderkey % 5 = 1 THEN 'minority' ELSE NULL END AS agreement_level FROM {orders}""",
    "claim_sources": """SELECT l_orderkey AS claim_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS source_ord, CASE WHEN l_suppkey % 9 = 0 THEN 'system' WHEN l_suppkey % 9 = 1 THEN concat('new_e', l_suppkey % 13, '_n', l_linenumber) WHEN l_suppkey % 9 = 2 THEN concat('e', l_suppkey % 13, ':evidence_', l_linenumber)
        WHEN l_suppkey % 9 = 3 THEN concat('arxiv:', l_suppkey) WHEN l_suppkey % 9 = 4 THEN concat('cand', l_suppkey) ELSE concat('e', l_suppkey % 13) END AS source_id FROM {lineitem}""",
    "panel": "SELECT DISTINCT concat('e', s_suppkey % 11) AS source_id FROM {supplier}",
    "scores": """SELECT run_id, candidate, dim_ord, concat('dim', dim_ord) AS dim, score FROM (SELECT o_custkey AS run_id, o_orderkey AS candidate, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dim_ord,
        CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 1 + l_partkey % 5 END AS score FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) x""",
    "weights": "SELECT concat('dim', k) AS dim, CAST(k AS DOUBLE) / 15 AS weight FROM (SELECT DISTINCT l_linenumber AS k FROM {lineitem} WHERE l_linenumber <= 5) x",
    "nodes": "SELECT concat('n', l_partkey % 300) AS node_id, l_linenumber AS graph_ord, l_orderkey AS node_ord, concat('e', l_suppkey % 13) AS expert_id, l_returnflag AS claim FROM {lineitem}",
    "edges": "SELECT concat('n', l_partkey % 200) AS source, concat('n', l_suppkey % 90) AS target, l_linenumber AS graph_ord, l_orderkey AS edge_ord, l_linestatus AS relation FROM {lineitem}",
    "panel_wide": "SELECT concat('e', s_suppkey % 17) AS source_id FROM {supplier} UNION SELECT concat('x', n_nationkey % 3) FROM {nation}",
    "cited": """SELECT l_orderkey AS claim_id, concat('e', l_suppkey % 13) AS source_id FROM {lineitem}
        UNION ALL SELECT o_orderkey, concat(CASE WHEN o_orderkey % 5 = 1 THEN 'm' ELSE 'c' END, o_orderkey % 17) FROM {orders}""",
    "quotes": """SELECT doc_id AS quote_id, doc_id AS source_id, CASE doc_id % 4 WHEN 0 THEN substr(text, 5, 60) WHEN 1 THEN translate(substr(text, 5, 60), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN substr(text, 5, 60) || ' zz'
        ELSE '  ' || substr(text, 5, 60) || ' ' END AS quote, text FROM {documents}""",
    "calls": "SELECT event_id AS call_id, event_type AS endpoint, CAST(event_id % 997 AS DOUBLE) * 1.25 AS arrival, user_id FROM {events}",
    "drafts": "SELECT conv_id AS doc, turn AS pos, role, text FROM {conversations}",
    "authored": """SELECT concat('e', n_nationkey) AS source_id, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE 1990 + n_nationkey END AS year, n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat('http://x/', n_nationkey) END AS url, n_nationkey AS k, n_name AS name FROM {nation}""",
}


#: Bases that join and number the rows of a key, with the keys of their tables.
DEALT = {"scores": {"lineitem": "l_orderkey", "orders": "o_orderkey"}, "claim_sources": {"lineitem": "l_orderkey"}}
#: Rows of a partition of these.
ROWS_OF_PART = 1 << 19


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base by its name, or a fixture table."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    sql = BASES[name]
    tables = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    if name in DEALT:
        tables |= zip(DEALT[name], dealt(*((tables[t], key) for t, key in DEALT[name].items())), strict=True)
    return spark.sql(sql, **tables)


def dealt(*frames: tuple[DataFrame, str]) -> list[DataFrame]:
    """Frames of Parquet tables (frame, key) dealt out by their keys, all to the same number of partitions, which grows with their rows.

    What joins, windows and groups by the keys then needs no other shuffle, and a task's memory
    stays the same however large the tables are. Rows are counted from the files' footers.
    """
    n = sum(df.count() for df, _ in frames)
    parts = max(int(frames[0][0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_OF_PART))
    return [df.repartition(parts, key) for df, key in frames]


#: Words of the runs by which quotes find their documents.
RUN = 5


#: A text in upper case character by character, as DuckDB's upper makes it: one that has no single capital (ligatures) stays; Spark's own makes two of it.
UPPER = "array_join(transform(regexp_extract_all({0}, '(?s).', 0), c -> CASE WHEN c = 'ß' THEN 'ẞ' WHEN length(upper(c)) = 1 THEN upper(c) WHEN length(initcap(c)) = 1 THEN initcap(c) ELSE c END), '')"


def all_quotes(items: DataFrame, documents: DataFrame) -> DataFrame:
    """As the base `quotes`, but of all documents that contain an item's text, whatever their ids.

    An item's words but the first and the last are whole words of such a document, so that the
    second to the sixth are one of the document's runs; items of fewer than seven words have no
    such run and are looked for in every document.
    """
    cut = lambda column: F.split(column, r"\s+", -1)
    b = items.select(F.col("item_id").alias("quote_id"), F.col("text").alias("item")).withColumn("words", cut(F.col("item")))
    d = documents.select(F.col("doc_id").alias("source_id"), "text")
    long = b.filter(F.size("words") >= RUN + 2).select("quote_id", F.array_join(F.slice("words", 2, RUN), " ").alias("run"))
    runs = F.expr(f"array_distinct(transform(sequence(1, size(words) - {RUN - 1}), i -> array_join(slice(words, i, {RUN}), ' ')))")
    by_run = d.withColumn("words", cut(F.col("text"))).filter(F.size("words") >= RUN).select("source_id", F.explode(runs).alias("run"))
    ids = by_run.join(long, "run").select(F.col("source_id").alias("s"), F.col("quote_id").alias("q")).distinct()
    with_text = ids.join(d, F.col("s").eqNullSafe(F.col("source_id"))).join(b.filter(F.size("words") >= RUN + 2).drop("words"), F.col("q").eqNullSafe(F.col("quote_id"))).drop("s", "q")
    met = with_text.unionByName(d.join(b.filter(F.size("words") < RUN + 2).drop("words"), F.contains("text", "item")))
    quote = F.expr(f"CASE WHEN quote_id % 3 = 0 THEN {UPPER.format('item')} WHEN quote_id % 3 = 1 THEN concat(' ', item, ' ') ELSE concat(item, ' x') END")
    return met.filter(F.contains("text", "item")).select("quote_id", "source_id", quote.alias("quote"), "text")


def ctes(*names: str) -> str:
    """The same bases as common table expressions for DuckDB."""
    return ", ".join(f"{n} AS ({BASES[n].format(**{t: t for t in TABLES})})" for n in names)


def query(name: str, oracle: str | None = None, *bases: str) -> Callable:
    """Register a query of (spark, sf_dir), and its oracle, which may use the bases named."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: tidy(f(lambda n: rows(spark, sf_dir, n)))
        if oracle is not None:
            ORACLES[name] = f"WITH {ctes(*bases)} {oracle}" if bases and not oracle.lstrip().startswith(",") else (f"WITH {ctes(*bases)}{oracle}" if bases else oracle)
        return f

    return add


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions as double with six places."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)
