"""Queries over the carriers: name, DataFrame function, and SQL for DuckDB with the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandwise.functions import dna, headers, kernels, quality
from strandwise.operators import align, columns, graph, kmers, mapping, pileup, reorder, stats, streams
from strandwise.plans.oracle import kmers as sql_kmers
from strandwise.plans.oracle import minimizers as sql_minimizers
from strandwise.plans.oracle import rc, sql
from strandwise.sources import carrier
from strandwise.sources.carrier import PHREDS, aln, bases, hdr, reads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def long_columns(df: DataFrame) -> DataFrame:
    """Whole numbers as long, and doubles to 6 digits, as the SQL has them."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        out.append(c.alias(f.name))
    return df.select(*out)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: long_columns(f(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


# ---- entropies and code lengths

def sql_entropy(symbol: str, context: str, source: str = "bases") -> str:
    """SQL of stats.entropy: h, n, n_contexts."""
    return f"SELECT round((sum(n * log2(n)) - sum(own)) / sum(n), 6) h, sum(n)::BIGINT n, count(*) n_contexts FROM (SELECT {context or '1'} c, sum(n) n, sum(n * log2(n)) own FROM (SELECT {context or '1'} c0, {context + ', ' if context else ''}{symbol}, count(*) n FROM {source} GROUP BY ALL) GROUP BY {context or '1'})"


BASE_CONTEXTS = {"none": "", "pos": "pos", "prev1": "p1", "prev2": "p2", "prev3": "p3", "qual": "q", "qual_prev": "q, p1", "pos5_qual_prev": "pos5, q, p1"}
QUAL_CONTEXTS = {"none": "", "pos": "pos", "base": "base", "pos_base": "pos, base", "prev1": "p1", "prev2": "p2", "prev_q": "q1", "prev_q2": "q1, q2", "pos_prev_q": "pos, q1"}


HISTORY = (
    "hist AS (SELECT i - 1 AS pos, (i - 1) // 5 AS pos5, substr(seq, i, 1) base, ascii(substr(qual, i, 1)) - 33 q, CASE WHEN i > 1 THEN substr(seq, i - 1, 1) END p1, "
    "CASE WHEN i > 2 THEN substr(seq, i - 2, 2) END p2, CASE WHEN i > 3 THEN substr(seq, i - 3, 3) END p3, CASE WHEN i > 1 THEN ascii(substr(qual, i - 1, 1)) - 33 END q1, "
    "CASE WHEN i > 2 THEN ascii(substr(qual, i - 2, 1)) - 33 END q2 FROM (SELECT *, unnest(range(1, length(seq) + 1)) i FROM reads))"
)


def models(spark: SparkSession, sf_dir: str, symbol: str, contexts: dict[str, str]) -> DataFrame:
    own = {name: [x for x in context.split(", ") if x] for name, context in contexts.items()}
    return stats.entropies_of(kernels.context_counts(reads(spark, sf_dir), {name: [*by, symbol] for name, by in own.items()}), own)


def sql_models(symbol: str, contexts: dict[str, str]) -> str:
    parts = []
    for name, context in contexts.items():
        keep = " AND ".join(f"{x} IS NOT NULL" for x in context.split(", ") if x) or "true"
        group = context + ", " if context else ""
        inner = f"SELECT {group}{symbol}, count(*) n FROM hist WHERE {keep} GROUP BY ALL"
        by = f"GROUP BY {context}" if context else ""
        parts.append(f"SELECT '{name}' model, round((sum(n * log2(n)) - sum(own)) / sum(n), 6) h, sum(n)::BIGINT n, count(*) n_contexts FROM (SELECT sum(n) n, sum(n * log2(n)) own FROM ({inner}) {by})")
    return sql(" UNION ALL ".join(parts), HISTORY)


@query(sql_models("base", BASE_CONTEXTS))
def base_entropy_models(spark, sf_dir):
    """H(base) and H(base | context) for each context."""
    return models(spark, sf_dir, "base", BASE_CONTEXTS)


@query(sql_models("q", QUAL_CONTEXTS))
def quality_entropy_models(spark, sf_dir):
    """H(quality) and H(quality | context) for each context."""
    return models(spark, sf_dir, "q", QUAL_CONTEXTS)


@query(sql("SELECT round((sum(n * log2(n)) - sum(own)) / sum(n), 6) h, sum(n)::BIGINT n, count(*) n_contexts FROM (SELECT pos, sum(n) n, sum(n * log2(n)) own FROM (SELECT pos, base, count(*) n FROM bases GROUP BY ALL) GROUP BY pos)"))
def base_entropy_by_position(spark, sf_dir):
    """Bits of a base given its position: the flagship query."""
    return stats.entropy(bases(reads(spark, sf_dir)), "base", ["pos"])


@query(sql("SELECT k::BIGINT k, round(sum(n * log2(n * t / (a * b))) / max(t), 6) mi, max(t)::BIGINT n FROM (SELECT k, n, sum(n) OVER (PARTITION BY k) t, sum(n) OVER (PARTITION BY k, c) a, sum(n) OVER (PARTITION BY k, base) b FROM (SELECT 1 k, p1 c, base, count(*) n FROM hist WHERE p1 IS NOT NULL GROUP BY ALL UNION ALL SELECT 2, p2, base, count(*) FROM hist WHERE p2 IS NOT NULL GROUP BY ALL UNION ALL SELECT 3, p3, base, count(*) FROM hist WHERE p3 IS NOT NULL GROUP BY ALL)) GROUP BY k", HISTORY))
def mutual_information_previous_bases(spark, sf_dir):
    """I(base; k bases before it) for k = 1, 2, 3, from one count of each joint pair."""
    joint = kernels.context_counts(reads(spark, sf_dir), {str(k): [f"p{k}", "base"] for k in (1, 2, 3)})
    joint = joint.select(F.col("model").cast("int").alias("k"), F.coalesce("p1", "p2", "p3").alias("c"), "base", "n").where("c is not null")
    total = lambda *by: F.sum("n").over(Window.partitionBy("k", *by))  # noqa: E731  (a few thousand rows)
    terms = joint.select("k", "n", total().alias("t"), total("c").alias("a"), total("base").alias("b"))
    return terms.groupBy("k").agg((F.sum(F.col("n") * F.log2(F.col("n") * F.col("t") / (F.col("a") * F.col("b").cast("double")))) / F.max("t")).alias("mi"), F.max("t").alias("n"))


@query(sql("SELECT pos, count(*) n, round(avg(q), 6) mean_q, round(stddev_pop(q), 6) sd_q FROM bases GROUP BY pos"))
def positional_quality_stats(spark, sf_dir):
    return bases(reads(spark, sf_dir)).groupBy("pos").agg(F.count("*").alias("n"), F.avg("q").alias("mean_q"), F.stddev_pop("q").alias("sd_q"))


@query(sql("SELECT q, base, count(*) n, round(count(*) / sum(count(*)) OVER (PARTITION BY q), 6) share FROM bases GROUP BY q, base"))
def base_composition_by_quality(spark, sf_dir):
    counted = bases(reads(spark, sf_dir)).groupBy("q", "base").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("q")))


@query("WITH e AS (SELECT user_id, event_type y, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) x FROM events), k AS (SELECT count(DISTINCT event_type) k FROM events), j AS (SELECT coalesce(x, '') x, y, count(*) n FROM e GROUP BY ALL), c AS (SELECT x, sum(n) n, sum(lgamma(n + 1)) own FROM j GROUP BY x) SELECT sum(n)::BIGINT n, round(sum(lgamma(n + k) - lgamma(k) - own) / ln(2), 4) bits FROM c, k GROUP BY ()")
def adaptive_code_length(spark, sf_dir):
    """Adaptive code length of event types given the type before it of the same user."""
    ev = carrier.table(spark, sf_dir, "events")
    k = ev.select("event_type").distinct().count()
    own = ev.select("event_type", F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit("")).alias("x"))
    return stats.adaptive_bits(own, "event_type", ["x"], k).select("n", F.round("bits", 4).alias("bits"))


@query("WITH t AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 n FROM events) SELECT n // 10 AS checkpoint, count(*) AS symbols, round(sum(-log2((c + 1) / (n + 5))) / count(*), 6) AS bits_each FROM t GROUP BY ALL")
def convergence_curve(spark, sf_dir):
    """Bits a symbol of an adaptive model of each user, by tens of symbols seen."""
    by = Window.partitionBy("user_id")
    ev = carrier.table(spark, sf_dir, "events").select(
        (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1).alias("c"), (F.row_number().over(by.orderBy("ts", "event_id")) - 1).alias("n")
    )
    return ev.groupBy(F.expr("n div 10").alias("checkpoint")).agg(F.count("*").alias("symbols"), (F.sum(-F.log2((F.col("c") + 1) / (F.col("n") + 5))) / F.count("*")).alias("bits_each"))


# ---- sequences

@query(sql(f"SELECT ord, {rc('seq')} rc, reverse(translate(seq, 'ACGTacgt', 'TGCATGCA')) rc_keep FROM reads"))
def reverse_complement(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", dna.reverse_complement(F.col("seq")).alias("rc"), dna.reverse_complement_keep(F.col("seq")).alias("rc_keep"))


@query(sql(f"SELECT ord, least(seq, {rc('seq')}) canon, {rc('seq')} < seq was_rc, true restored FROM reads"))
def rc_canonical(spark, sf_dir):
    canon, was = dna.canonical(F.col("seq")), dna.is_reverse(F.col("seq"))
    return reads(spark, sf_dir).select("ord", canon.alias("canon"), was.alias("was_rc"), (dna.restore(canon, was) == F.col("seq")).alias("restored"))


SHARES = " + ".join(f"(CASE WHEN contains(seq, '{b}') THEN (length(seq) - length(replace(seq, '{b}', ''))) / length(seq) * log2((length(seq) - length(replace(seq, '{b}', ''))) / length(seq)) ELSE 0 END)" for b in "ACGT")


@query(sql(f"SELECT ord, round(-({SHARES}) + 0.0, 6) h, length(seq) - length(replace(seq, 'N', '')) n_count FROM reads"))
def base_composition_entropy(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", (F.round(dna.composition_entropy(F.col("seq")), 6) + 0.0).alias("h"), dna.count_of(F.col("seq"), "N").alias("n_count"))


@query(sql("SELECT ord, d, CASE WHEN d <= 110 THEN d END AS near FROM (SELECT ord, (SELECT count(*) FROM (SELECT unnest(range(1, least(length(seq), length(p)) + 1)) i) WHERE substr(seq, i, 1) <> substr(p, i, 1)) d FROM (SELECT ord, seq, lag(seq) OVER (PARTITION BY chunk ORDER BY ord) p FROM reads) WHERE p IS NOT NULL)"))
def hamming_previous_read(spark, sf_dir):
    w = Window.partitionBy("chunk").orderBy("ord")
    own = reads(spark, sf_dir).select("ord", "seq", F.lag("seq").over(w).alias("p")).where("p is not null")
    return own.select("ord", dna.hamming(F.col("seq"), F.col("p")).alias("d"), dna.hamming(F.col("seq"), F.col("p"), 110).alias("near"))


# the hash of a k-mer and that of its reverse complement, one term for each letter: whole columns at a time, so the SQL is fit for all k-mers
TERMS = lambda x, k: " + ".join(f"instr('CGT', substr({x}, {i}, 1))::BIGINT * {4 ** (k - i)}" for i in range(1, k + 1))
TURNED = lambda x, k: " + ".join(f"(3 - instr('CGT', substr({x}, {i}, 1)))::BIGINT * {4 ** (i - 1)}" for i in range(1, k + 1))


@query(sql(f"SELECT *, hash >> 34 hint FROM (SELECT ord, pos, {TERMS('x', 21)} hash, x kmer, {TURNED('x', 21)} reverse FROM (SELECT ord, pos, substr(seq, pos + 1, 21) x FROM (SELECT ord, seq, unnest(range(0, length(seq) - 20)) pos FROM reads)) WHERE x NOT LIKE '%N%')"))
def kmer_hashes(spark, sf_dir):
    """Hash of every 21-mer of every read, its position, the k-mer from the hash, the hash of its reverse complement and its hint."""
    return kernels.kmer_hashes(reads(spark, sf_dir), 21).withColumn("hint", F.shiftright("hash", 34))


@query(sql("SELECT chunk, sum(CASE WHEN contains(seq, 'N') THEN ceil(length(seq) / 2) ELSE ceil(length(seq) / 4) END)::BIGINT seq_bytes, sum(ceil(length(qual) * 3 / 8))::BIGINT q8, sum(ceil(length(qual) * 2 / 8))::BIGINT q4, sum(ceil(length(qual) / 8))::BIGINT q2, sum(ceil(length(qual) * 7 / 8))::BIGINT q_all FROM reads GROUP BY chunk"))
def packed_sizes(spark, sf_dir):
    q = lambda mode: F.sum(quality.packed_size(F.col("qual"), mode))
    return reads(spark, sf_dir).groupBy("chunk").agg(F.sum(dna.packed_size(F.col("seq"))).alias("seq_bytes"), q("illumina8").alias("q8"), q("four").alias("q4"), q("binary").alias("q2"), q("lossless").alias("q_all"))


@query(sql("SELECT ord, replace(substr(seq, (c - w + 1), w), 'N', 'A') l, replace(substr(seq, c + 1, w), 'N', 'A') r FROM (SELECT *, least(c, CASE WHEN n > 100 THEN 32 ELSE n * 32 // 100 END) w FROM (SELECT ord, seq, length(seq) n, length(seq) // 2 c FROM reads))"))
def centre_windows(spark, sf_dir):
    w = dna.centre_windows(F.col("seq"))
    return reads(spark, sf_dir).select("ord", w["left"].alias("l"), w["right"].alias("r"))


@query(sql("SELECT ord, string_agg((instr('CGT', substr(seq, i, 1)) - instr('CGT', substr(p, i, 1)) + 4) % 4, '' ORDER BY i) deltas FROM (SELECT *, unnest(range(1, least(length(seq), length(p)) + 1)) i FROM (SELECT ord, seq, lag(seq) OVER (PARTITION BY chunk ORDER BY ord) p FROM reads) WHERE p IS NOT NULL) GROUP BY ord"))
def mod4_deltas(spark, sf_dir):
    """Base codes of a read minus those of the read before, modulo 4, one digit each."""
    own = reads(spark, sf_dir).select("ord", "seq", F.lag("seq").over(Window.partitionBy("chunk").orderBy("ord")).alias("p")).where("p is not null")
    return own.select("ord", F.array_join(dna.mod4_delta(F.col("seq"), F.col("p")).cast("array<string>"), "").alias("deltas"))


# ---- k-mers

for _k in (5, 11):
    def _counts(spark, sf_dir, k=_k):
        return kmers.counts(reads(spark, sf_dir), k)

    _counts.__name__ = f"kmer_counts_k{_k}"
    query(sql(f"SELECT kmer, least(count(*), 65535) n FROM {sql_kmers(_k)} GROUP BY kmer"))(_counts)


@query(sql(f"SELECT kmer, n FROM (SELECT *, avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END) OVER () share FROM (SELECT kmer, least(count(*), 65535) n FROM {sql_kmers(15)} GROUP BY kmer)) WHERE n > 1 OR share > 0.9"))
def tip_trimmed_kmers(spark, sf_dir):
    return kmers.trim_tips(kmers.counts(reads(spark, sf_dir), 15))


@query(sql(f"SELECT n, count(*) n_kmers FROM (SELECT kmer, least(count(*), 65535) n FROM {sql_kmers(11)} GROUP BY kmer) GROUP BY n"))
def kmer_frequency_of_frequencies(spark, sf_dir):
    return kmers.counts(reads(spark, sf_dir), 11).groupBy("n").agg(F.count("*").alias("n_kmers"))


@query(sql(f"SELECT place, kmer, n, (sum(n) OVER (ORDER BY place))::BIGINT covered FROM (SELECT kmer, n, row_number() OVER (ORDER BY n DESC, kmer) place FROM (SELECT kmer, least(count(*), 65535) n FROM {sql_kmers(11)} GROUP BY kmer)) WHERE place <= 20"))
def top_kmers(spark, sf_dir):
    """The 20 most frequent 11-mers and what they cover together."""
    top = kmers.counts(reads(spark, sf_dir), 11).orderBy(F.desc("n"), "kmer").limit(20)
    w = Window.orderBy(F.desc("n"), "kmer")  # 20 rows
    return top.select(F.row_number().over(w).alias("place"), "kmer", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("covered"))


@query(sql("SELECT sum(length(seq))::BIGINT total, CASE WHEN sum(length(seq)) < 5000000 THEN 15 WHEN sum(length(seq)) < 50000000 THEN 19 WHEN sum(length(seq)) < 500000000 THEN 23 WHEN sum(length(seq)) < 2000000000 THEN 27 ELSE 31 END::BIGINT k FROM reads"))
def kmer_size_choice(spark, sf_dir):
    total = reads(spark, sf_dir).agg(F.sum(F.length("seq")).alias("total"))
    return total.select("total", F.when(F.col("total") < 5_000_000, 15).when(F.col("total") < 50_000_000, 19).when(F.col("total") < 500_000_000, 23).when(F.col("total") < 2_000_000_000, 27).otherwise(31).alias("k"))


@query(sql(f"SELECT m.ord, string_agg(m.m, ',' ORDER BY m.place) minimizers FROM {sql_minimizers(21, 11)} m GROUP BY m.ord"))
def minimizer_pairs(spark, sf_dir):
    """The minimizers of each read in order."""
    return kernels.minimizer_lists(reads(spark, sf_dir), 21, 11).select("ord", F.array_join("m", ",").alias("minimizers"))


@query(sql(f"SELECT minimizer, ord, place FROM (SELECT m minimizer, ord, row_number() OVER (PARTITION BY m ORDER BY ord) place FROM (SELECT DISTINCT m, ord FROM {sql_minimizers(21, 11)})) WHERE place <= 50"))
def minimizer_dictionary(spark, sf_dir):
    return kmers.minimizer_index(reads(spark, sf_dir)).select("minimizer", "ord", "place")


@query(sql(f"SELECT DISTINCT ord FROM (SELECT ord, count(*) OVER (PARTITION BY m) n FROM (SELECT DISTINCT ord, m FROM {sql_minimizers(21, 11)})) WHERE n > 1"))
def shared_minimizer_semijoin(spark, sf_dir):
    return kmers.sharing(reads(spark, sf_dir))


SYNC = f"(SELECT ord, min({{'kmer': least(x, {rc('x')}), 'pos': pos}}) s FROM {sql_kmers(21)} WHERE substr(x, 1, 10) = list_min(list_transform(range(1, 13), lambda j: substr(x, j, 10))) GROUP BY ord)"


@query(sql(f"SELECT ord, s.kmer kmer, s.pos pos FROM {SYNC}"))
def open_syncmer_keys(spark, sf_dir):
    return kernels.syncmers(reads(spark, sf_dir), ["ord"]).where("kmer is not null").select("ord", "kmer", F.col("spos").alias("pos"))


NEXT = f"(SELECT kmer, base, n, row_number() OVER (PARTITION BY kmer ORDER BY n DESC, base) - 1 AS rank FROM (SELECT substr(x, 1, 4) kmer, substr(x, 5, 1) base, count(*) n FROM {sql_kmers(5)} GROUP BY ALL))"


@query(sql(f"SELECT * FROM {NEXT}"))
def next_base_table(spark, sf_dir):
    """How often each base follows a 4-mer, with the rank that recoding gives it."""
    return kmers.next_base(reads(spark, sf_dir), 4)


@query(sql(f"SELECT ord, string_agg(rank, '' ORDER BY k.pos) ranks FROM {sql_kmers(5)} k JOIN {NEXT} t ON substr(k.x, 1, 4) = t.kmer AND substr(k.x, 5, 1) = t.base GROUP BY ord"))
def rank_recode(spark, sf_dir):
    """Ranks of a read's bases under the 4 before them. The table has at most 1024 rows, so it is broadcast."""
    r = reads(spark, sf_dir)
    return kmers.ranks(r, kmers.next_base(r, 4), 4)


K9 = f"t AS (SELECT kmer FROM {sql_kmers(9)} GROUP BY kmer HAVING count(*) > 1)"
EXT = lambda x: f"least({x}, {rc(x)})"


@query(sql(f"SELECT t.kmer, (SELECT count(*) FROM (SELECT unnest(['A','C','G','T']) b) WHERE {EXT('substr(t.kmer, 2) || b')} IN (SELECT kmer FROM t)) n_out, (SELECT count(*) FROM (SELECT unnest(['A','C','G','T']) b) WHERE {EXT('b || substr(t.kmer, 1, 8)')} IN (SELECT kmer FROM t)) n_in FROM t", K9))
def debruijn_degrees(spark, sf_dir):
    return kmers.successors(kmers.counts(reads(spark, sf_dir), 9).where("n > 1").select("kmer"))


# ---- qualities

def sql_map(f) -> str:
    to = "".join(chr(33 + f(ord(c) - 33)) for c in PHREDS).replace("'", "''")
    return f"translate(qual, '{PHREDS}', '{to}')"


@query(sql(f"SELECT ord, {sql_map(quality.eight_level)} illumina8, {sql_map(quality.four_level)} four, {sql_map(quality.binary)} bin2, repeat('!', length(qual)) discard FROM reads"))
def quantised_qualities(spark, sf_dir):
    q = lambda mode: quality.quantise(F.col("qual"), mode)
    return reads(spark, sf_dir).select("ord", q("illumina8").alias("illumina8"), q("four").alias("four"), q("binary").alias("bin2"), q("discard").alias("discard"))


@query(sql(f"SELECT ord, {sql_map(lambda q: quality.eight_bin(quality.eight_level(q)))} illumina8, {sql_map(lambda q: 40 if q >= 20 else 10)} bin2 FROM reads"))
def stored_qualities(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", quality.stored(F.col("qual"), "illumina8").alias("illumina8"), quality.stored(F.col("qual"), "binary").alias("bin2"))


@query(sql("SELECT ord, (33 + sum(q) // count(*))::BIGINT mean_q, min(q)::BIGINT least, max(q)::BIGINT most FROM bases GROUP BY ord"))
def mean_quality(spark, sf_dir):
    v = quality.values(F.col("qual"))
    return reads(spark, sf_dir).select("ord", quality.mean(F.col("qual")).alias("mean_q"), F.array_min(v).alias("least"), F.array_max(v).alias("most"))


@query(sql("SELECT chunk, count(*) n, count(*) FILTER (WHERE d = 0) n_zero, count(*) FILTER (WHERE d <> 0 AND abs(d) <= 3) n_small, max(abs(d))::BIGINT most FROM (SELECT chunk, greatest(-128, least(127, ascii(substr(qual, i, 1)) - 33 - CASE WHEN i <= length(p) THEN ascii(substr(p, i, 1)) - 33 ELSE 30 END)) d FROM (SELECT *, unnest(range(1, length(qual) + 1)) i FROM (SELECT chunk, qual, lag(qual) OVER (PARTITION BY chunk ORDER BY ord) p FROM reads) WHERE p IS NOT NULL)) GROUP BY chunk"))
def quality_delta_stats(spark, sf_dir):
    """Differences of qualities to the read before, by position; 30 stands for a missing one."""
    own = reads(spark, sf_dir).select("chunk", "qual", F.lag("qual").over(Window.partitionBy("chunk").orderBy("ord")).alias("p")).where("p is not null")
    d = own.select("chunk", F.explode(F.zip_with(quality.values(F.col("qual")), F.slice(quality.values(F.col("p")), 1, F.length("qual")), lambda a, b: a - F.coalesce(b, F.lit(30)))).alias("d"))
    d = d.withColumn("d", quality.clamp8(F.col("d")))
    return d.groupBy("chunk").agg(F.count("*").alias("n"), F.count(F.when(F.col("d") == 0, 1)).alias("n_zero"), F.count(F.when((F.col("d") != 0) & (F.abs("d") <= 3), 1)).alias("n_small"), F.max(F.abs("d")).alias("most"))


CODE = lambda x: f"CASE {x} WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 4 END"


@query(sql(f"SELECT (least(pos // 5, 63) * 2500 + least(coalesce(q1, 0), 49) * 50 + (CASE WHEN abs(coalesce(q1, 0) - coalesce(q2, 0)) <= 2 THEN 0 ELSE 25 END) + ({CODE('p1')}) * 5 + ({CODE('base')}))::BIGINT context, count(*) n, round(avg(q), 6) mean_q FROM hist GROUP BY ALL", HISTORY))
def quality_contexts(spark, sf_dir):
    h = kernels.context_counts(reads(spark, sf_dir), {"": ["pos5", "q1", "steady", "p1", "base", "q"]})
    q1 = F.coalesce("q1", F.lit(0))
    c = quality.context(F.col("pos5") * 5, q1, q1 + F.col("steady") * 3, F.coalesce("p1", F.lit("-")), F.col("base"))
    return h.groupBy(c.alias("context")).agg(F.sum("n").alias("n"), (F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("mean_q"))


@query(sql("SELECT pos, q median, n total FROM (SELECT pos, q, row_number() OVER (PARTITION BY pos ORDER BY q) - 1 r, count(*) OVER (PARTITION BY pos) n FROM bases WHERE ord IN (SELECT ord FROM reads WHERE length(seq) = (SELECT n FROM (SELECT length(seq) n, count(*) c FROM reads GROUP BY 1) ORDER BY c DESC, n LIMIT 1))) WHERE r = n // 2"))
def positional_median_model(spark, sf_dir):
    """Upper median of the qualities at each position of the reads of the most frequent length."""
    return columns.median_model(reads(spark, sf_dir))


@query(sql("SELECT chunk, string_agg(DISTINCT c, '' ORDER BY c) alphabet, count(DISTINCT c) n FROM (SELECT chunk, chr((q + 33)::INT) c FROM bases) GROUP BY chunk"))
def quality_alphabet(spark, sf_dir):
    symbols = reads(spark, sf_dir).select("chunk", F.explode(F.array_distinct(F.split("qual", ""))).alias("c")).where("c != ''").distinct()
    return symbols.groupBy("chunk").agg(F.array_join(F.sort_array(F.collect_list("c")), "").alias("alphabet"), F.count("*").alias("n"))


# ---- headers

SRA = "(SELECT event_id ord, '@ERR' || (user_id % 2) || '.' || (event_id + 1) || ' A:' || (user_id % 3) || ':FC:' || (event_id % 4 + 1) || ':' || (event_id % 90000) || ':' || ((event_id * 53) % 30000) || ':' || ((event_id * 7) % 40000) || (CASE WHEN event_id % 2 = 0 THEN '/1' ELSE '' END) header FROM events)"


def sra_headers(spark, sf_dir):
    return carrier.table(spark, sf_dir, "events").selectExpr("event_id as ord", "concat('@ERR', user_id % 2, '.', event_id + 1, ' A:', user_id % 3, ':FC:', event_id % 4 + 1, ':', event_id % 90000, ':', (event_id * 53) % 30000, ':', (event_id * 7) % 40000, case when event_id % 2 = 0 then '/1' else '' end) as header")


@query(sql("SELECT ord, 'casava' fmt, split_part(header[2:], ':', 1) || ':' || split_part(header, ':', 2) || ':' || split_part(header, ':', 3) combo, split_part(header, ':', 4)::BIGINT lane, split_part(header, ':', 5)::BIGINT tile, split_part(header, ':', 6)::BIGINT x, split_part(split_part(header, ':', 7), ' ', 1)::BIGINT y, split_part(header, ' ', 2) comment FROM hdr"))
def parse_casava_headers(spark, sf_dir):
    p = headers.parse(F.col("header"))
    return hdr(spark, sf_dir).select("ord", p.alias("p")).select("ord", "p.fmt", "p.combo", "p.lane", "p.tile", "p.x", "p.y", "p.comment")


@query(f"SELECT ord, CASE WHEN t <= 65535 THEN 'sra' END fmt, CASE WHEN t <= 65535 THEN n END read_num, CASE WHEN t <= 65535 THEN t END tile, CASE WHEN t <= 65535 THEN header END rebuilt FROM (SELECT ord, header, split_part(split_part(header, ' ', 1), '.', 2)::BIGINT n, split_part(header, ':', 5)::BIGINT t FROM {SRA})")
def parse_sra_headers(spark, sf_dir):
    """Fields of archive headers and the header put together again; a tile beyond 16 bits is no such header."""
    own = sra_headers(spark, sf_dir).select("ord", headers.parse(F.col("header")).alias("p"))
    return own.select("ord", "p.fmt", "p.read_num", "p.tile", headers.rebuild(F.col("p")).alias("rebuilt"))


@query(sql("SELECT combo, row_number() OVER (ORDER BY first) - 1 AS code, n, first FROM (SELECT split_part(header[2:], ':', 1) || ':' || split_part(header, ':', 2) || ':' || split_part(header, ':', 3) combo, min(ord) AS first, count(*) n FROM hdr GROUP BY ALL)"))
def combo_dictionary(spark, sf_dir):
    """Whole dictionary of run names by first appearance; its order is one window over the distinct names."""
    p = hdr(spark, sf_dir).select("ord", headers.parse(F.col("header"))["combo"].alias("combo"))
    table = p.groupBy("combo").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    return table.select("combo", (F.row_number().over(Window.orderBy("first")) - 1).alias("code"), "n", "first")


@query(sql("SELECT ord, header FROM hdr"))
def header_round_trip(spark, sf_dir):
    """Headers put together again from their fields."""
    own = hdr(spark, sf_dir).select("ord", headers.parse(F.col("header")).alias("p"))
    return own.select("ord", headers.rebuild(F.col("p")).alias("header"))


ZIG = lambda d: f"xor(({d}) * 2, ({d}) >> 63)"
VAR = lambda z: f"greatest(1, ceil(length(ltrim(bin({z}), '0')) / 7))"


@query(sql(f"SELECT u, count(*) n, sum({VAR(ZIG('dx'))})::BIGINT x_bytes, sum({VAR(ZIG('dy'))})::BIGINT y_bytes, bool_and(abs(dx) <= 1) narrow FROM (SELECT u, x - lag(x, 1, 0::BIGINT) OVER (PARTITION BY u ORDER BY ord) dx, y - lag(y, 1, 0::BIGINT) OVER (PARTITION BY u ORDER BY ord) dy FROM (SELECT ord, split_part(header, ':', 4)::BIGINT u, split_part(header, ':', 6)::BIGINT x, split_part(split_part(header, ':', 7), ' ', 1)::BIGINT y FROM hdr)) GROUP BY u"))
def header_delta_sizes(spark, sf_dir):
    """Bytes of the coordinates as zigzag varint deltas, by lane."""
    p = hdr(spark, sf_dir).select("ord", headers.parse(F.col("header")).alias("p")).select("ord", F.col("p.lane").alias("u"), "p.x", "p.y")
    w = Window.partitionBy("u").orderBy("ord")
    d = p.select("u", (F.col("x") - F.lag("x", 1, 0).over(w)).alias("dx"), (F.col("y") - F.lag("y", 1, 0).over(w)).alias("dy"))
    size = lambda c: F.sum(dna.varint_size(dna.zigzag(F.col(c))))
    return d.groupBy("u").agg(F.count("*").alias("n"), size("dx").alias("x_bytes"), size("dy").alias("y_bytes"), F.every(F.abs("dx") <= 1).alias("narrow"))


# ---- orders

@query(sql(f"SELECT r.ord, r.chunk, row_number() OVER (PARTITION BY r.chunk ORDER BY s.kmer NULLS LAST, s.pos NULLS LAST, m, r.ord) place FROM (SELECT ord, chunk, (33 + sum(q) // count(*)) m FROM bases GROUP BY ALL) r LEFT JOIN (SELECT ord, s.kmer kmer, s.pos pos FROM {SYNC}) s ON r.ord = s.ord"))
def sorted_by_reorder_key(spark, sf_dir):
    """Place of each read in its chunk by syncmer, its position and mean quality."""
    own = kernels.syncmers(reads(spark, sf_dir).select("ord", "chunk", "seq", quality.mean(F.col("qual")).alias("m")), ["ord", "chunk", "m"])
    return reorder.ranked(own, [F.col("kmer"), F.col("spos"), F.col("m")])


@query(sql("SELECT ord, chunk, first, row_number() OVER (PARTITION BY chunk ORDER BY first, ord) place FROM (SELECT ord, chunk, min(ord) OVER (PARTITION BY chunk, substr(seq, 1, 8)) AS first FROM reads)"))
def grouped_order(spark, sf_dir):
    """Reads that begin alike stand together where the first of them stood."""
    return reorder.grouped(reads(spark, sf_dir), F.substr("seq", F.lit(1), F.lit(8)))


@query(sql("SELECT ord, chunk, row_number() OVER (PARTITION BY chunk ORDER BY seq, ord) lexicographic, row_number() OVER (PARTITION BY chunk ORDER BY least(seq, " + rc("seq") + "), ord) canonical, row_number() OVER (PARTITION BY chunk ORDER BY substr(qual, 1, 16) || right(qual, 16), ord) AS ends FROM reads"))
def sort_key_places(spark, sf_dir):
    keys, w = reorder.sort_keys(), Window.partitionBy("chunk")
    return reads(spark, sf_dir).select("ord", "chunk", *[F.row_number().over(w.orderBy(keys[k], "ord")).alias(k) for k in ("lexicographic", "canonical", "ends")])


@query(sql(f"SELECT chunk, count(*) n, count(*) FILTER (WHERE o = place) n_fixed, sum({VAR(ZIG('step'))})::BIGINT delta_bytes FROM (SELECT *, o - lag(o, 1, 0::BIGINT) OVER (PARTITION BY chunk ORDER BY place) step FROM (SELECT chunk, row_number() OVER (PARTITION BY chunk ORDER BY ord) o, row_number() OVER (PARTITION BY chunk ORDER BY seq, ord) place FROM reads)) GROUP BY chunk"))
def permutation_cost(spark, sf_dir):
    return reorder.permutation_cost(reorder.ranked(reads(spark, sf_dir), [F.col("seq")]))


@query(sql("SELECT chunk, block, first, n, row_number() OVER (PARTITION BY chunk ORDER BY s, block) place FROM (SELECT chunk, block, min(ord) AS first, count(*) n, arg_min(seq, ord) s FROM (SELECT *, (row_number() OVER (PARTITION BY chunk ORDER BY ord) - 1) // 8 AS block FROM reads) GROUP BY ALL)"))
def block_sort(spark, sf_dir):
    return reorder.blocks(reads(spark, sf_dir), 8)


@query(sql("SELECT chunk, pos, string_agg(base, '' ORDER BY ord) col FROM bases GROUP BY ALL"))
def transposed_columns(spark, sf_dir):
    """Column-major form: the bases of a chunk's reads at each position, in read order."""
    return streams.transposed(reads(spark, sf_dir))


# ---- alignments

@query(sql("SELECT ord, count(*) n, count(ref_pos) n_aligned, min(ref_pos)::BIGINT first, max(ref_pos)::BIGINT last, sum(nibble)::BIGINT nibbles FROM steps GROUP BY ord"))
def cigar_walk(spark, sf_dir):
    s = align.walk(aln(spark, sf_dir))
    return s.groupBy("ord").agg(F.count("*").alias("n"), F.count("ref_pos").alias("n_aligned"), F.min("ref_pos").alias("first"), F.max("ref_pos").alias("last"), F.sum("nibble").alias("nibbles"))


@query(sql("SELECT ref_id, ref_pos, nibble::BIGINT nibble, n FROM votes"))
def consensus_majority(spark, sf_dir):
    return pileup.consensus(aln(spark, sf_dir))


@query(sql("SELECT ref_id, seg segment, min(pos) AS first, max(e)::BIGINT AS last, count(*) n FROM (SELECT *, (sum(far) OVER (PARTITION BY ref_id ORDER BY pos, e, ord))::BIGINT seg FROM (SELECT *, CASE WHEN pos > max(e) OVER (PARTITION BY ref_id ORDER BY pos, e, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50000 THEN 1 ELSE 0 END far FROM (SELECT ord, ref_id, pos, pos + list_sum(list_transform(cigar, lambda o: CASE WHEN o.op IN (0, 2, 3, 7, 8) THEN o.len ELSE 0 END)) e FROM aln WHERE ref_id >= 0))) GROUP BY ALL"))
def consensus_segments(spark, sf_dir):
    return align.segments(aln(spark, sf_dir))


@query(sql("SELECT ord, count(*) FILTER (WHERE s.ref_pos IS NOT NULL) n_diff, count(*) FILTER (WHERE s.ref_pos IS NOT NULL AND xor(s.nibble, coalesce(v.nibble, 0)) = 0) n_equal, count(*) FILTER (WHERE s.ref_pos IS NULL) n_extra, sum(CASE WHEN s.ref_pos IS NULL THEN s.nibble ELSE xor(s.nibble, coalesce(v.nibble, 0)) END)::BIGINT diffs FROM steps s LEFT JOIN votes v ON s.ref_id = v.ref_id AND s.ref_pos = v.ref_pos GROUP BY ord"))
def consensus_differences(spark, sf_dir):
    own = aln(spark, sf_dir)
    return pileup.summed(pileup.differences(own, pileup.consensus(own)))


@query(sql("SELECT ord, string_agg(base, '' ORDER BY query_pos) seq FROM steps GROUP BY ord"))
def consensus_round_trip(spark, sf_dir):
    """Sequences rebuilt from the consensus and the differences to it."""
    own = aln(spark, sf_dir)
    return pileup.rebuild(pileup.differences(own, pileup.consensus(own)))


@query(sql(f"SELECT ord, ref_id - lr d_ref, CASE WHEN ref_id = lr THEN pos - lp ELSE pos END d_pos, {ZIG('tlen')} zig_tlen, next_ref_id - ref_id mate_ref, next_pos - pos mate_pos FROM (SELECT *, lag(ref_id, 1, 0::BIGINT) OVER (PARTITION BY chunk ORDER BY ref_id, pos, ord) lr, lag(pos, 1, 0::BIGINT) OVER (PARTITION BY chunk ORDER BY ref_id, pos, ord) lp FROM aln)"))
def position_deltas(spark, sf_dir):
    d = align.deltas(aln(spark, sf_dir))
    return d.select("ord", "d_ref", "d_pos", dna.zigzag(F.col("tlen")).alias("zig_tlen"), (F.col("next_ref_id") - F.col("ref_id")).alias("mate_ref"), (F.col("next_pos") - F.col("pos")).alias("mate_pos"))


@query(sql("SELECT ord, ref_id, pos FROM aln"))
def position_round_trip(spark, sf_dir):
    """References and positions rebuilt from their deltas."""
    return align.undo_deltas(align.deltas(aln(spark, sf_dir))).select("ord", F.col("back_ref").alias("ref_id"), F.col("back_pos").alias("pos"))


SLOTS = "slots AS (SELECT name, max(CASE WHEN flag & 64 > 0 THEN ord END) ord1, max(CASE WHEN flag & 128 > 0 THEN ord END) ord2 FROM aln WHERE flag & 2304 = 0 GROUP BY name)"


@query(sql("SELECT name, ord1, ord2 FROM slots WHERE ord1 IS NOT NULL AND ord2 IS NOT NULL", SLOTS))
def mate_pairs(spark, sf_dir):
    return align.mates(aln(spark, sf_dir))[0]


@query(sql("SELECT coalesce(ord1, ord2) ord FROM slots WHERE ord1 IS NULL OR ord2 IS NULL", SLOTS))
def unpaired_reads(spark, sf_dir):
    return align.mates(aln(spark, sf_dir))[1]


@query(sql("SELECT ord, '@' || name id, CASE WHEN flag & 16 > 0 THEN reverse(translate(seq, 'ACGTN', 'TGCAN')) ELSE seq END seq, CASE WHEN flag & 16 > 0 THEN reverse(qual) ELSE qual END qual FROM aln"))
def records_to_reads(spark, sf_dir):
    return align.to_reads(aln(spark, sf_dir))


# ---- similarity

REFS = "refs AS (SELECT doc_id AS ref, substr(b, 1, length(b)) AS seq FROM mapped WHERE doc_id % 10 = 3)"


@query(sql(f"SELECT ord, other, round(1 - d / n, 6) AS identity FROM (SELECT ord, other, n, (SELECT count(*) FROM (SELECT unnest(range(1, n + 1)) i) WHERE substr(seq, i, 1) <> substr(p, i, 1)) d FROM (SELECT r.ord, seq, length(seq) n, lag(r.ord) OVER w AS other, lag(seq) OVER w AS p FROM reads r JOIN (SELECT ord, s.kmer kmer FROM {SYNC}) s ON r.ord = s.ord WINDOW w AS (PARTITION BY chunk, kmer ORDER BY r.ord)) WHERE other IS NOT NULL AND length(p) = n) WHERE 1 - d / n > 0.6"))
def cached_delta_candidates(spark, sf_dir):
    return mapping.cached_candidates(reads(spark, sf_dir))


@query(None)
def read_to_reference_hits(spark, sf_dir):
    """Best place of every read in the whole texts of other documents: references are the documents' first copies."""
    docs = carrier.table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("t"))
    refs = docs.groupBy(F.xxhash64("t").alias("key")).agg(F.min(F.struct("doc_id", "t")).alias("m")).select(F.col("m.doc_id").alias("ref"), F.translate("m.t", carrier.LETTERS, carrier.BASES).alias("seq"))
    return mapping.best_hits(reads(spark, sf_dir), refs)


@query(None)
def read_components(spark, sf_dir):
    return graph.read_groups(reads(spark, sf_dir))


@query(None)
def unitigs(spark, sf_dir):
    """Maximal unbranched paths over the 21-mers that reads have twice or more."""
    return graph.unitigs(reads(spark, sf_dir))


# ---- reports

@query(sql("SELECT chunk, min(length(seq)) = max(length(seq)) AS constant, CASE WHEN min(length(seq)) = max(length(seq)) THEN min(length(seq)) ELSE 0 END const_length FROM reads GROUP BY chunk"))
def constant_lengths(spark, sf_dir):
    n = F.length("seq")
    same = F.min(n) == F.max(n)
    return reads(spark, sf_dir).groupBy("chunk").agg(same.alias("constant"), F.when(same, F.min(n)).otherwise(0).alias("const_length"))


@query(sql("SELECT chunk, count(*) n, sum(length(seq))::BIGINT n_bases, sum(length(ord::VARCHAR) + length(seq) + length(qual) + 3)::BIGINT n_bytes FROM reads GROUP BY chunk"))
def chunk_sizes(spark, sf_dir):
    return reads(spark, sf_dir).groupBy("chunk").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("n_bases"), F.sum(F.length(F.col("ord").cast("string")) + F.length("seq") + F.length("qual") + 3).alias("n_bytes"))


@query(sql("SELECT ord, '@' || ord || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS record FROM reads"))
def fastq_records(spark, sf_dir):
    return reads(spark, sf_dir).select("ord", F.concat(F.lit("@"), F.col("ord").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("record"))


@query(sql("SELECT stream, raw, packed, round(raw / packed, 6) ratio FROM (SELECT 'seq' stream, sum(length(seq))::BIGINT raw, sum(CASE WHEN contains(seq, 'N') THEN ceil(length(seq) / 2) ELSE ceil(length(seq) / 4) END)::BIGINT packed FROM reads UNION ALL SELECT 'qual', sum(length(qual))::BIGINT, sum(ceil(length(qual) * 7 / 8))::BIGINT FROM reads)"))
def stream_sizes(spark, sf_dir):
    r = reads(spark, sf_dir).agg(F.sum(F.length("seq")).alias("a"), F.sum(dna.packed_size(F.col("seq"))).alias("b"), F.sum(F.length("qual")).alias("c"), F.sum(quality.packed_size(F.col("qual"), "lossless")).alias("d"))
    long = r.select(F.expr("stack(2, 'seq', a, b, 'qual', c, d) as (stream, raw, packed)"))
    return long.withColumn("ratio", F.col("raw") / F.col("packed"))


@query(None)
def record_fingerprint(spark, sf_dir):
    """Order-insensitive fingerprint of the records of each chunk, and its size."""
    crc = F.crc32(F.concat_ws("\n", F.col("ord").cast("string"), "seq", "qual").cast("binary"))
    return reads(spark, sf_dir).groupBy("chunk").agg(F.sum(crc).alias("fingerprint"), F.count("*").alias("n"))


from strandwise.plans import records  # noqa: E402, F401  (adds its queries)
