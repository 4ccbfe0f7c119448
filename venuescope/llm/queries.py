"""The queries of the operators for the driver contract, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.kept import spread
from . import decontaminate, exact_dedup, fingerprints, itemsets, line_dedup, mixing, packing, pii, search, secrets, simhash, toxicity, url_filter


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edited_texts(_docs(spark, sf_dir))
    a, e, n = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.printed(a).alias("fingerprint"),
        fingerprints.printed(e).alias("edited_fingerprint"),
        fingerprints.likeness(a, e).alias("near_edited"),
        fingerprints.likeness(a, n).alias("near_next"),
        fingerprints.containment(a, e).alias("held_edited"),
        fingerprints.containment(a, n).alias("held_next"),
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_dedup.exact_dedup(_docs(spark, sf_dir))
    return done.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(_docs(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first_id FROM k),
d AS (SELECT *, length(key) >= 10 AND doc_id > first_id AS gone FROM m)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_docs(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Without the setting the result is a demonstration: the key then stands in the source.
    key = spark.conf.get(pii.KEY_SETTING, None)
    done = pii.pseudonymise(_docs(spark, sf_dir).select("doc_id", "text"), key.encode() if key else pii.DEMONSTRATION)
    counts = [F.regexp_count("spans", F.lit(rf"(^|,){kind}:")).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return done.select("doc_id", "text", F.coalesce("spans", F.lit("")).alias("spans"), *counts)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_scores(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secrets.scan(_docs(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return done.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(secrets.printed(F.col("base")), 256).alias("base_sha256"),
        secrets.printed(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_copied",
        "n_repositories",
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_docs(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op11_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where("not flag <=> 'returned'")
    sets, frequent, baskets = itemsets.itemsets(lines, "sale_id", "item_id")
    told = itemsets.rules(sets, frequent, baskets).withColumn("rule", F.struct("item", F.concat_ws(":", "item", "a", "s").alias("text")))
    told = told.groupBy("items").agg(F.sort_array(F.collect_list("rule")).alias("rules"), F.min(F.struct("a", "item")).alias("best"))
    made = itemsets.with_items(sets, frequent).join(told, "items", "left")
    rules = F.concat_ws(";", F.transform("rules", lambda r: r["text"]))
    return made.select(
        itemsets.names_of(F.col("members")).alias("items"),
        F.size("members").cast("long").alias("n_items"),
        "support",
        F.coalesce(F.size("rules"), F.lit(0)).cast("long").alias("n_rules"),
        F.col("best.item").alias("best_item"),
        F.sha2(F.coalesce(rules, F.lit("")), 256).alias("rules_sha256"),
    )


OP11_SQL = """
WITH RECURSIVE b AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL),
n AS (SELECT count(DISTINCT sale_id) AS B FROM b),
f AS (SELECT * FROM (SELECT sale_id, item_id, count(*) OVER (PARTITION BY item_id) AS s FROM b), n WHERE s >= 12 AND s * 10000 >= B),
grown AS (
    SELECT [item_id] AS items, item_id AS last, sale_id, s AS support FROM f
    UNION ALL
    SELECT items, last, sale_id, support FROM (
        SELECT list_append(g.items, f.item_id) AS items, f.item_id AS last, g.sale_id,
               count(*) OVER (PARTITION BY list_append(g.items, f.item_id)) AS support
        FROM grown g JOIN f ON f.sale_id = g.sale_id AND f.item_id > g.last), n
    WHERE support >= 12 AND support * 10000 >= B),
sets AS (SELECT DISTINCT items, support FROM grown),
part AS (SELECT s.items, s.support, c.c, list_filter(s.items, lambda x: x <> c.c) AS rest FROM sets s, unnest(s.items) AS c(c) WHERE len(s.items) > 1),
sub AS (SELECT p.*, r.support AS a, i.support AS s FROM part p JOIN sets r ON r.items = p.rest JOIN sets i ON i.items = [p.c]),
closed AS (SELECT * FROM sets WHERE NOT EXISTS (SELECT 1 FROM sub WHERE sub.rest = sets.items AND sub.support = sets.support)),
rules AS (SELECT items, count(*) AS n_rules, arg_min(c, {'a': a, 'c': c}) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS told
          FROM sub, n WHERE 100 * support >= 30 * a AND support * B > a * s GROUP BY items)
SELECT array_to_string(c.items, ',') AS items, CAST(len(c.items) AS BIGINT) AS n_items, c.support, coalesce(r.n_rules, 0) AS n_rules, r.best_item,
       sha256(coalesce(r.told, '')) AS rules_sha256
FROM closed c LEFT JOIN rules r ON r.items = c.items
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("item_id", "rank", "doc_id", "score")


WORDS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH t AS (SELECT doc_id, unnest({WORDS_SQL.format("text")}) AS term FROM documents),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM d),
q AS (SELECT DISTINCT item_id, unnest({WORDS_SQL.format("text")}) AS term FROM benchmark),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(N) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
s AS (SELECT q.item_id, p.doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 90 + ((90 * d.n * c.N) // c.L))))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN d USING (doc_id), c GROUP BY q.item_id, p.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 10
"""


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.scan(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return done.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({WORDS_SQL.format("text")}, []) AS ws FROM documents),
b AS (SELECT item_id, {WORDS_SQL.format("text")} AS ws FROM benchmark),
w AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(ws)) AS n,
             unnest([array_to_string(ws[i + 1 : i + least(10, len(ws))], ' ') FOR i IN range(greatest(len(ws) - 9, least(len(ws), 1)))]) AS part FROM b WHERE len(ws) > 0),
ns AS (SELECT DISTINCT n FROM w),
o AS (SELECT r, n, unnest(range(len(ws) - n + 1)) AS i, unnest([array_to_string(ws[i + 1 : i + n], ' ') FOR i IN range(len(ws) - n + 1)]) AS part FROM d, ns WHERE len(ws) >= n),
m AS (SELECT o.r, o.n, o.i, w.item FROM o JOIN w USING (n, part)),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS pos FROM m) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN l USING (r)
"""


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_packing": op9_packing,
    "op10_url_filter": op10_url_filter,
    "op11_itemsets": op11_itemsets,
    "op12_search": op12_search,
    "op13_decontaminate": op13_decontaminate,
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op11_itemsets": OP11_SQL, "op12_search": OP12_SQL, "op13_decontaminate": OP13_SQL}
