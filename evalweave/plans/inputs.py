"""Views of the driver tables that stand in for scored samples, runs, tokens and boxes; each with the SQL of the same view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalweave.functions.boxes import box


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score, a risk, a signed margin and a confidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("n_chars")
    return docs.select(
        F.col("doc_id").alias("id"), "lang", "source", "n_chars", "quality", "toxic",
        ((n % 101) / 101.0).alias("score"), ((n % 97) / 97.0).alias("risk"), ((n % 89) / 44.5 - 1).alias("margin"), (F.lit(0.5) + (n % 83) / 166.0).alias("confidence"),
    )


SCORED = """scored as (select d.doc_id as id, d.lang, d.source, d.n_chars, l.quality, l.toxic, (d.n_chars % 101)::double / 101 as score, (d.n_chars % 97)::double / 97 as risk,
  (d.n_chars % 89)::double / 44.5::double - 1 as margin, 0.5::double + (d.n_chars % 83)::double / 166 as confidence from documents d join labels l on d.doc_id = l.doc_id)"""


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Two runs over the same lines: price before and after discount and tax, per order cluster."""
    lines = table(spark, sf_dir, "lineitem")
    value = F.col("l_quantity") * (1 - F.col("l_discount")) if name == "left" else F.col("l_quantity") * (1 - F.col("l_tax"))
    return lines.groupBy(F.col("l_orderkey").alias("cluster"), F.col("l_linenumber").alias("line")).agg(F.max(F.col("l_returnflag")).alias("flag"), F.sum(value).alias("value"))


RUNS = """runs as (select l_orderkey as cluster, l_linenumber as line, max(l_returnflag) as flag, sum(l_quantity * (1 - l_discount)) as lv, sum(l_quantity * (1 - l_tax)) as rv from lineitem group by 1, 2)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrays of boxes per order, from the numbers of its lines."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x, y = (F.col("l_partkey") % 50) / 100.0, (F.col("l_suppkey") % 50) / 100.0
    w, h = F.col("l_quantity") / 100.0, F.lit(0.1) + F.col("l_discount")
    rows = l.select("l_orderkey", "l_linenumber", box(x, y, x + w, y + h).alias("a"), box(y, x, y + h, x + w).alias("b"))
    return rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("a")).alias("kept"), F.sort_array(F.collect_list("b")).alias("evidence"))


BOX_ROWS = """box_rows as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, (l_partkey % 50)::double / 100 as x1, (l_suppkey % 50)::double / 100 as y1,
  (l_partkey % 50)::double / 100 + l_quantity / 100 as x2, (l_suppkey % 50)::double / 100 + (0.1::double + l_discount) as y2,
  (l_suppkey % 50)::double / 100 as ex1, (l_partkey % 50)::double / 100 as ey1, (l_suppkey % 50)::double / 100 + (0.1::double + l_discount) as ex2, (l_partkey % 50)::double / 100 + l_quantity / 100 as ey2 from lineitem)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the tokens of samples of 64 each, with a place, relevance, uniqueness, saliency and anchors."""
    v = F.col("embedding").cast("array<double>")
    at = lambda i: (F.greatest(F.lit(-0.5), F.least(F.lit(0.499), v[i])) + 0.5)
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 64).alias("sample_id"), (F.col("vec_id") % 64).alias("idx"), at(0).alias("x"), at(1).alias("y"), v[2].alias("relevance"), F.abs(v[3]).alias("uniqueness"), F.abs(v[4]).alias("saliency"),
        (F.col("label") == 0).alias("anchor"), v.alias("vec"), "label",
    )


#: Half the width of a token's box.
HALF = 1 / 16


def token_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`tokens` with boxes around their places and, the same for all tokens of a sample, the boxes of its first two anchors as evidence."""
    t = tokens(spark, sf_dir)
    t = t.withColumns({"x1": F.col("x") - HALF, "y1": F.col("y") - HALF, "x2": F.col("x") + HALF, "y2": F.col("y") + HALF})
    return t.join(token_regions(t), "sample_id", "left")


def token_regions(boxed: DataFrame) -> DataFrame:
    found = F.sort_array(F.collect_list(F.when(F.col("anchor"), F.struct("idx", F.struct("x1", "y1", "x2", "y2").alias("box")))))
    return boxed.groupBy("sample_id").agg(F.transform(F.slice(found, 1, 2), lambda s: s["box"]).alias("regions"))


PROBE_NAMES = ["flip_mapped", "flip_unmapped", "vertical_flip_mapped", "vertical_flip_unmapped", "inverse_role", "role_reversal", "text_only", "subject_masked", "object_masked", "crop", "contra", "prompt_sc_1", "prompt_sc_2"]
FAMILY_NAMES = ["left_right", "vertical", "topology", "proximity", "depth", "interaction"]


def probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as scored probes of a sample: the first line is the orig probe."""
    lines = table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("ord")).agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("k"), F.max("l_returnflag").alias("flag"))
    name = F.element_at(F.array(*map(F.lit, PROBE_NAMES)), ((F.col("k") + F.col("ord")) % len(PROBE_NAMES) + 1).cast("int"))
    margin = (F.col("q") - 25.5) / 10 * F.when(F.col("k") % 3 == 0, -1).otherwise(1)
    family = F.element_at(F.array(*map(F.lit, FAMILY_NAMES)), (F.col("sample_id") % len(FAMILY_NAMES) + 1).cast("int"))
    rows = lines.select("sample_id", "ord", F.when(F.col("ord") == 1, "orig").otherwise(name).alias("probe"), margin.alias("margin"), F.when(F.col("flag") == "R", "no").otherwise("yes").alias("target_answer"), family.alias("family"))
    return rows.withColumn("predicted", F.when(F.col("margin") >= 0, "yes").otherwise("no")).withColumn("correct", F.col("predicted") == F.col("target_answer"))


def _names(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


PROBE_ROWS = f"""lines as (select l_orderkey as sample_id, l_linenumber as ord, max(l_quantity) as q, max(l_partkey) as k, max(l_returnflag) as flag from lineitem group by 1, 2),
probe_rows as (select sample_id, ord, case when ord = 1 then 'orig' else {_names(PROBE_NAMES)}[((k + ord) % {len(PROBE_NAMES)} + 1)::int] end as probe, (q - 25.5::double) / 10 * (case when k % 3 = 0 then -1 else 1 end) as margin,
  case when flag = 'R' then 'no' else 'yes' end as target, {_names(FAMILY_NAMES)}[(sample_id % {len(FAMILY_NAMES)} + 1)::int] as family from lines),
last_rows as (select sample_id, probe, arg_max(margin, ord) as m, arg_max(target, ord) as target, any_value(family) as family from probe_rows group by 1, 2)"""


TOKENS = """tokens as (select vec_id // 64 as sample_id, vec_id % 64 as idx, greatest(-0.5::double, least(0.499::double, embedding[1]::double)) + 0.5::double as x, greatest(-0.5::double, least(0.499::double, embedding[2]::double)) + 0.5::double as y,
  embedding[3]::double as relevance, abs(embedding[4]::double) as uniqueness, label from embeddings)"""
