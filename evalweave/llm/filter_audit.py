"""How filters interact: what each removes at each step of every order in which they can be applied.

All orders of n filters make a trie of permutations. What survives a prefix depends on the prefix's set alone, so the trie folds into
the 2**n sets: its states. States are visited depth first. A state's survivors are a persisted DataFrame, made from its parent's survivors by one filter;
a state that another order has reached before isn't applied again. Every edge (a state and the next filter) counts the rows that the filter removes from the state's survivors:
one partial sum of all edges of a state a task. At most n + 1 states are persisted at a time; counts are written to the shared folder as each state is left, so that a lost executor costs the recomputation of one path at most.

What the filters look at is measured once a document and written (:func:`measured`): survivors carry an id, a part and numbers, never texts. Repeated texts are found by a digest: the smallest doc_id of each
digest is a partial minimum a task, and the digests that occur more than once meet the rows again in a join that Spark can split.

Cases: a null or empty text is empty, has no words, and equals other such texts; a null part is the empty string and one with it; a row with a null doc_id has no label and repeats nothing, and nothing repeats it;
rows that share doc_id and text are not smaller than one another, so each is counted and none repeats the other; rows that share a doc_id share its label. Several labels of one doc_id count as good or toxic if one of them is.
Labels without a document are ignored, as are all other columns, whatever their names. An empty table has no parts and gives no rows. A part in which a step has nothing left gives zeros.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalweave.llm.common import columns, scratch, written

WORD_BREAK = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = r"[#$%&*|]"
#: Thresholds of the five filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
#: Orders grow with the factorial of the filters: 5,040 of seven.
MOST_FILTERS = 7


def standard_filters() -> dict[str, Column]:
    """The failure condition of each filter over the columns of :func:`measured`."""
    return {
        "A": F.col("words") < LEAST_WORDS,
        "B": F.col("distinct_words") * 100 < F.col("words") * LEAST_DISTINCT,
        "C": F.col("capitals") * 100 > F.col("code_points") * MOST_CAPITALS,
        "D": F.col("marked"),
        "E": F.col("repeats"),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """A written row per document: doc_id, part, words, distinct_words, capitals, code_points, marked, and whether a smaller doc_id has the same text (repeats)."""
    doc_id, text, part = columns([id_col, text_col, part_col])
    text = F.coalesce(text.cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(part.cast("string"), F.lit("")).alias("part"))
    words = F.filter(F.split("text", WORD_BREAK), lambda w: w != "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words")))[0]
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    made = rows.select(
        "doc_id", "part", counts.alias("counts"), capitals.cast("long").alias("capitals"), F.length("text").cast("long").alias("code_points"), F.col("text").rlike(MARKS).alias("marked"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    )
    made = written(made.select("doc_id", "part", "counts.*", "capitals", "code_points", "marked", "digest"), "measured")
    # one row a digest and task; digests of a single id need no second look
    first = made.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last").select("digest", "first")
    return made.join(first, "digest", "left").select("doc_id", "part", "words", "distinct_words", "capitals", "code_points", "marked", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("repeats"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``rows`` with good and toxic, from quality = 1 and toxic = 1 of the labels of their doc_id."""
    key, quality, toxic = columns([id_col, "quality", "toxic"])
    each = labels.where(key.isNotNull()).groupBy(key.alias("doc_id")).agg(F.max(F.coalesce(quality == 1, F.lit(False))).alias("good"), F.max(F.coalesce(toxic == 1, F.lit(False))).alias("toxic"))
    return rows.join(each, "doc_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})


def edge_counts(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(state, filter, part, rows, removed, good_lost, toxic_lost) of every edge: a state is the set of filters before, as bits in the order of ``filters``.

    ``rows`` has part, good and toxic and what the filters read. Parts without survivors in a state have no row there.
    """
    names = list(filters)
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    fails = {n: F.coalesce(c, F.lit(False)).alias(f"fails{i}") for i, (n, c) in enumerate(filters.items())}
    root = written(rows.select("part", "good", "toxic", *fails.values()), "filtered")
    path, seen = scratch(rows.sparkSession, "edges"), set()

    def visit(state: int, survivors: DataFrame) -> None:
        seen.add(state)
        after = [i for i in range(len(names)) if not state >> i & 1]
        one = lambda c: F.sum(c.cast("long"))
        sums = [one(F.col(f"fails{i}") & F.col(x) if x else F.col(f"fails{i}")).alias(f"{x or 'removed'}{i}") for i in after for x in ("", "good", "toxic")]
        edges = F.array(*[F.struct(F.lit(names[i]).alias("filter"), F.col(f"removed{i}").alias("removed"), F.col(f"good{i}").alias("good_lost"), F.col(f"toxic{i}").alias("toxic_lost")) for i in after])
        counted = survivors.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), *sums)
        counted.select("part", "rows", F.explode(edges).alias("e")).select("part", "rows", "e.*").write.parquet(f"{path}/state={state}")
        for i in after:
            child = state | 1 << i
            if child not in seen and len(after) > 1:  # the full set has no edge left
                left = survivors.where(f"not fails{i}").persist(StorageLevel.MEMORY_AND_DISK)
                visit(child, left)
                left.unpersist()

    visit(0, root)
    schema = "part string, rows long, filter string, removed long, good_lost long, toxic_lost long, state int"
    return rows.sparkSession.read.schema(schema).option("basePath", path).parquet(path)


def audit(rows: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """A row per part, order and step: part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    names = list(filters)
    spark = rows.sparkSession
    edges = edge_counts(rows, filters)
    steps = [("".join(order), k + 1, name, sum(1 << names.index(x) for x in order[:k])) for order in permutations(names) for k, name in enumerate(order)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, filter string, state int")
    parts = edges.where("state = 0").select("part").distinct()
    # a row for every edge of every part, then of every order: literal tables of n * 2**(n - 1) and n * n! rows
    full = (1 << len(names)) - 1
    grid = parts.select("part", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.lit(n).alias("filter")) for s in range(full) for i, n in enumerate(names) if not s >> i & 1])).alias("e")).select("part", "e.*")
    every = grid.join(edges, ["part", "state", "filter"], "left").na.fill(0, ["rows", "removed", "good_lost", "toxic_lost"])
    weights = spark.createDataFrame([(n, s, factorial(s.bit_count()) * factorial(len(names) - 1 - s.bit_count()), s == 0, s == full - (1 << i)) for s in range(full) for i, n in enumerate(names) if not s >> i & 1], "filter string, state int, orders int, first boolean, last boolean")
    whole = every.join(F.broadcast(weights), ["filter", "state"]).groupBy("part", "filter")
    whole = whole.agg(F.max(F.when(F.col("first"), F.col("removed"))).alias("fails"), F.max(F.when(F.col("last"), F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    out = every.join(whole, ["part", "filter"]).join(F.broadcast(orders), ["filter", "state"])
    return out.select(
        "part", "filter_order", "step", "filter", (F.col("rows") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five standard filters over documents and their labels."""
    return audit(labelled(measured(docs), labels), standard_filters())


def audit_sql() -> str:
    """The same by counting, for each step of each order, the documents that fail none of the filters before."""
    words = r"regexp_extract_all(t.text, '[^\x20\x09-\x0D]+')"
    letters = "(values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as t(f, bit)"
    return f"""
with texts as (select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part from documents),
firsts as (select text, min(doc_id) as first from texts group by 1),
measures as (select t.doc_id, t.part, t.text, {words} as w, coalesce(t.doc_id > f.first, false) as e from texts t join firsts f on t.text = f.text),
labelled as (select doc_id, max(coalesce(quality = 1, false)) as good, max(coalesce(toxic = 1, false)) as toxic from labels where doc_id is not null group by 1),
fails as (select m.part as part, coalesce(l.good, false) as good, coalesce(l.toxic, false) as toxic,
  (case when len(w) < {LEAST_WORDS} then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) then 2 else 0 end)
  + (case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(text) then 4 else 0 end)
  + (case when regexp_matches(text, '{MARKS}') then 8 else 0 end) + (case when e then 16 else 0 end) as mask
  from measures m left join labelled l on m.doc_id = l.doc_id),
counts as (select part, mask, count(*) as n, sum(good::int) as good, sum(toxic::int) as toxic from fails group by 1, 2),
parts as (select distinct part from counts),
letters as (select * from {letters}),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, step::int as step, substr(filter_order, step::int, 1) as filter, (select bit from letters where f = substr(filter_order, step::int, 1)) as bit,
  coalesce((select sum(bit) from letters where position(f in filter_order) < step), 0)::int as before from orders, range(1, 6) r(step)),
sums as (select p.part, s.filter_order, s.step, s.filter,
  coalesce(sum(n) filter (where mask & (before | bit) = 0), 0) as kept, coalesce(sum(n) filter (where mask & before = 0 and mask & bit <> 0), 0) as removed,
  coalesce(sum(n) filter (where mask & before <> 0 and mask & bit <> 0), 0) as redundant, coalesce(sum(n) filter (where mask = bit), 0) as unique_fails,
  coalesce(sum(good) filter (where mask & before = 0 and mask & bit <> 0), 0) as good_lost, coalesce(sum(toxic) filter (where mask & before = 0 and mask & bit <> 0), 0) as toxic_lost
  from parts p cross join steps s left join counts c on c.part = p.part group by 1, 2, 3, 4)
select part, filter_order, step, filter, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from sums"""
