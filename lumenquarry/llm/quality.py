"""Operator 7, quality rules: base counts and the divergence of a document from its language.

Two histograms of a document are held against those of its language (all documents with the same lang, null counting as
''): character classes, and common words, which are the lower-cased words that make up at least 1/COMMON of the
language's words. The measure is the Jensen-Shannon distance, the root of the divergence to base 2, from 0 to 1. A
document fails above MAX_WORD_DISTANCE or MAX_CHAR_DISTANCE. Guard: under MIN_WORDS words the distances aren't looked
at. Every language has a reference, however small its share.

Native throughout. The counts run over all documents. A sketch names words that may be common (its error is far below
the share asked for; sketches meet by language and group of tasks first) and exact counts decide; a language has at most COMMON common words. References are broadcast while their counted
size is small, and then the text is never shuffled: measures of a document are computed in its row, and kept for the
second look in the shared folder. Beyond that only those of languages with 1/LANGUAGE of the rows or more are broadcast,
at most LANGUAGE of them; rows of the others, none of which is a hot key, are joined by a shuffle.

Null or empty text: no words, so base_failed. Very long texts: whole. Repeated rows: each is judged for itself and
counts in the language. Null doc_id: judged like others. Null lang: a language of its own. Empty table: no rows. Extra
columns are ignored by `measure`; `quality_filter` returns them as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_BASE_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
MIN_WORDS, COMMON, LANGUAGE = 50, 100, 100
#: Groups of input tasks whose sketches of a language meet before they are one.
SALTS = 64
MAX_WORD_DISTANCE, MAX_CHAR_DISTANCE = 0.45, 0.3
#: Characters of the classes; what is in none of them is the last class.
SPACES, NOT_SPACE = "\x20\x09\x0a\x0b\x0c\x0d", r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
CLASSES = ("[A-Z]", "[0-9]", r"[.,;:!?'\"()-]", SYMBOLS)
GAPS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def common_candidates(docs: DataFrame) -> DataFrame:
    """lang and the words that may be common in it, at most 4 * COMMON of them, for languages with words."""
    words = docs.select("lang", F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), F.explode(words_of(F.lower("text"))).alias("w"))
    each = words.groupBy("lang", "salt").agg(F.expr(f"approx_top_k_accumulate(w, {200 * COMMON})").alias("s"), F.count("w").alias("n"))
    whole = each.groupBy("lang").agg(F.expr(f"approx_top_k_combine(s, {200 * COMMON})").alias("s"), F.sum("n").alias("n"))
    top = common.cut(whole.select("lang", F.expr(f"approx_top_k_estimate(s, {4 * COMMON})").alias("top"), "n"))
    maybe = F.filter("top", lambda x: x["count"] * (2 * COMMON) >= F.col("n"))
    return top.where("n > 0").select("lang", F.array_sort(F.transform(maybe, lambda x: x["item"])).alias("maybe"))


def by_language(rows: DataFrame, side: DataFrame, size: Column) -> DataFrame:
    """rows with what side, a table of a row for each lang, has; size: the bytes of a row of side."""
    side = common.cut(side)
    n_bytes = side.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    if n_bytes <= common.BROADCAST_BYTES:
        return rows.join(F.broadcast(side), "lang", "left")
    counts = common.cut(rows.groupBy("lang").agg(F.count("*").alias("_n")))
    all_rows = counts.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in counts.where(F.col("_n") * LANGUAGE >= all_rows).select("lang").collect()]
    is_hot = F.col("lang").isin(hot)
    return rows.where(is_hot).join(F.broadcast(side.where(is_hot)), "lang", "left").unionByName(rows.where(~is_hot).join(side.where(~is_hot).hint("shuffle_merge"), "lang", "left"))


def with_words(docs: DataFrame) -> DataFrame:
    """The base counts of each row, its class counts and its counts of `maybe` words."""
    n = F.size("words")
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.rlike(x, F.lit(NOT_SPACE)))
    spaced = F.concat(F.lit("  "), F.lower(F.array_join("words", "  ")), F.lit("  "))
    out = docs.withColumn("words", words_of(F.col("text")))
    out = out.withColumns({"h": F.when(n > WINDOW, hashes), "spaced": F.when(n > 0, spaced), "lines": lines})
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.struct(F.array_join(F.slice("words", i + 1, WINDOW), " ").alias("w"), i.alias("i")))
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(windows)))
    same = F.transform(
        F.sequence(F.lit(0), F.size("sorted") - 1),
        lambda k: F.when((F.get("sorted", k)["w"] == F.get("sorted", k - 1)["w"]) | (F.get("sorted", k)["w"] == F.get("sorted", k + 1)["w"]), F.get("sorted", k)["i"]),
    )
    out = out.withColumn("at", F.when(F.col("sorted").isNotNull(), F.array_sort(F.array_compact(same))))
    covered = F.aggregate(F.zip_with("at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
    counts = F.transform("maybe", lambda c: F.floor((F.octet_length("spaced") - F.octet_length(F.replace(F.col("spaced"), F.concat(F.lit(" "), c, F.lit(" ")), F.lit("")))) / (F.octet_length(c) + 2)))
    chars = [F.length("text") - F.col("word_chars"), *[F.regexp_count("text", F.lit(c)) for c in CLASSES[:-1]], F.col("n_symbols")]
    out = out.withColumns({"word_chars": F.length(F.array_join("words", "")).cast("long"), "n_symbols": F.regexp_count("text", F.lit(SYMBOLS)).cast("long")})
    return out.withColumns(
        {
            "n_words": n.cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": F.coalesce(F.when(F.col("at").isNotNull(), covered), F.lit(0)).cast("long"),
            "counts": F.coalesce(counts, F.transform("maybe", lambda _: F.lit(0).cast("long"))),
            "chars": F.array(*chars, F.length("text") - sum(chars[1:], chars[0])),
        }
    ).drop("words", "h", "spaced", "lines", "sorted", "at")


def references(measures: DataFrame) -> DataFrame:
    """For each language with words: its common words' places and shares, and its classes' shares; one row each."""
    sums = measures.groupBy("lang").agg(F.sum("n_words").alias("n"), F.first("maybe").alias("maybe"), *[F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES) + 2)])
    each = measures.select("lang", F.posexplode("counts").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    picked = each.join(sums.select("lang", "n"), "lang").where((F.col("x") * COMMON >= F.col("n")) & (F.col("n") > 0))
    words = picked.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", (F.col("x") / F.col("n")).alias("q")))).alias("common"))
    chars = F.array(*[F.col(f"c{k}").cast("double") for k in range(len(CLASSES) + 2)])
    whole = F.aggregate(chars, F.lit(0.0), lambda s, x: s + x)
    out = sums.where("n > 0").join(words, "lang", "left")
    return out.select("lang", F.coalesce("common", F.array().cast("array<struct<k:int,q:double>>")).alias("common"), F.transform(chars, lambda x: x / whole).alias("q_chars"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    part = lambda a, b: F.when(a > 0, a * F.log(2 * a / (a + b))).otherwise(0.0)
    total = F.aggregate(F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a)), F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)) / (2 * F.log(F.lit(2.0))))


def judged(measures: DataFrame) -> DataFrame:
    """measures with both distances, base_failed and kept."""
    rest = lambda a: F.concat(a, F.array(F.lit(1.0) - F.aggregate(a, F.lit(0.0), lambda s, x: s + x)))
    out = by_language(measures, references(measures), 16 * F.size("common") + 128).withColumns(
        {
            "p": rest(F.transform("common", lambda c: F.get("counts", c["k"]) / F.col("n_words"))),
            "q": rest(F.transform("common", lambda c: c["q"])),
            "p_chars": F.transform("chars", lambda x: x / F.aggregate("chars", F.lit(0.0), lambda s, y: s + y)),
        }
    )
    guarded = (F.col("n_words") >= MIN_WORDS) & F.col("common").isNotNull()
    out = out.withColumns({"word_distance": F.when(guarded, distance(F.col("p"), F.col("q"))), "char_distance": F.when(guarded, distance(F.col("p_chars"), F.col("q_chars")))})
    failed = (F.col("n_words") < MIN_BASE_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    far = (F.col("word_distance") > MAX_WORD_DISTANCE) | (F.col("char_distance") > MAX_CHAR_DISTANCE)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.coalesce(far, F.lit(False)))


def with_candidates(docs: DataFrame) -> DataFrame:
    """Rows of lang and text, with the words that may be common in their language."""
    return by_language(docs, common_candidates(docs), F.octet_length(F.array_join("maybe", "")) + 16 * F.size("maybe") + 64)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, both distances, base_failed and kept of every row."""
    docs = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_words(with_candidates(docs)).drop("text")
    return judged(common.cut(rows)).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "word_distance", "char_distance", "base_failed", "kept")


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that `measure` keeps, with all their columns.

    Rows are joined by doc_id and a hash of what decides (text, lang), so only verdicts that are `false` travel.
    """
    key = lambda: F.xxhash64(F.coalesce("lang", F.lit("")), F.coalesce("text", F.lit("")))
    plain = docs.select("doc_id", "lang", "text")
    inner = plain.select("doc_id", key().alias("_key"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    own, bad_id, bad_key = common.free(docs, "_key", "_bad", "_bad_key")
    rows = common.cut(with_words(with_candidates(inner)).drop("text"))
    bad = common.cut(judged(rows).where(~F.col("kept")).select(F.col("doc_id").alias(bad_id), F.col("_key").alias(bad_key)).distinct())
    n = bad.count()
    keyed = docs.withColumn(own, key())
    return common.small_or_shuffled(keyed, bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_key)), "left_anti", n, 24).drop(own)


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(common.table(spark, sf_dir, "documents")).drop("word_distance", "char_distance")


def _lit(chars: str) -> str:
    return " || ".join(f"chr({ord(c)})" if ord(c) < 33 or c in "'\"" else f"'{c}'" for c in chars)


OP7_SQL = rf"""
with d as (select doc_id, coalesce(lang, '') lang, coalesce(text, '') t, row_number() over () r from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, length(t) n_all,
    length(t) - length(translate(t, {_lit(SPACES)}, '')) c0, {", ".join(f"len(regexp_extract_all(t, '{c.replace(chr(39), chr(39) * 2)}')) c{k + 1}" for k, c in enumerate(CLASSES))} from d),
e as (select r, unnest(range(1, len(ws) + 1)) i, unnest(ws) w from w),
g as (select r, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' || lead(w, 4) over o v
    from e window o as (partition by r order by i)),
dup as (select r, i from (select r, i, count(*) over (partition by r, v) c from g where v is not null) where c > 1),
cov as (select r, count(distinct i + k) n from dup, range(5) t(k) group by r),
ln as (select r, count(*) - count(distinct l) n from (select r, unnest(string_split(t, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
lang_n as (select lang, sum(len(ws)) n, sum(n_all - c0 - c1 - c2 - c3 - c4) c5, sum(c0) c0, sum(c1) c1, sum(c2) c2, sum(c3) c3, sum(c4) c4 from w group by lang),
lw as (select w.lang, e.r, lower(e.w) w from e join w using (r)),
cw as (select lang, w, count(*) x from lw group by lang, w),
ref as (select cw.lang, w, x / n q from cw join lang_n using (lang) where x * {COMMON} >= n),
ok as (select * from lang_n where n > 0),
pk as (select r, w, count(*) c from lw group by r, w),
both_ as (select w.r, ref.q, coalesce(pk.c, 0) / len(w.ws) p from w join ok using (lang) join ref using (lang) left join pk on pk.r = w.r and pk.w = ref.w where len(w.ws) >= {MIN_WORDS}),
full_ as (select r, p, q from both_ union all select w.r, 1 - coalesce(sum(p), 0), 1 - coalesce(sum(q), 0) from w join ok using (lang) left join both_ on both_.r = w.r where len(w.ws) >= {MIN_WORDS} group by w.r),
chars as (select w.r, unnest([w.c0, w.c1, w.c2, w.c3, w.c4, w.n_all - w.c0 - w.c1 - w.c2 - w.c3 - w.c4]) / w.n_all p,
    unnest([ok.c0, ok.c1, ok.c2, ok.c3, ok.c4, ok.c5]) / (ok.c0 + ok.c1 + ok.c2 + ok.c3 + ok.c4 + ok.c5) q from w join ok using (lang) where len(w.ws) >= {MIN_WORDS}),
js as (select r, sqrt(greatest(sum(case when p > 0 then p * ln(2 * p / (p + q)) else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) else 0 end), 0) / (2 * ln(2))) x from full_ group by r),
jc as (select r, sqrt(greatest(sum(case when p > 0 then p * ln(2 * p / (p + q)) else 0 end + case when q > 0 then q * ln(2 * q / (p + q)) else 0 end), 0) / (2 * ln(2))) x from chars group by r),
b as (select w.r, doc_id, lang, len(ws)::bigint n_words, length(translate(t, {_lit(SPACES)}, ''))::bigint word_chars, c4::bigint n_symbols,
    coalesce(ln.n, 0)::bigint n_dup_lines, coalesce(cov.n, 0)::bigint n_repeat_words from w left join ln using (r) left join cov using (r))
select doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {MIN_BASE_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words base_failed,
    not (n_words < {MIN_BASE_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) and coalesce(js.x, 0) <= {MAX_WORD_DISTANCE} and coalesce(jc.x, 0) <= {MAX_CHAR_DISTANCE} kept
from b left join js using (r) left join jc using (r)
"""
