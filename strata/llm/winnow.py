"""Document fingerprints by winnowing, in DataFrame functions only.

Words (runs of characters other than white space) have hashes in two prime fields. k-gram
hashes are Rabin-Karp polynomials over them, rolled by doubling: the hash of 2m words is that of
its first m times base^m plus that of its last m, so that neighbouring grams share the hashes
of all their parts and a gram costs about log2(k) steps. (A hash that gives up its first word for the
next one needs a running state along the array, which array functions don't have.) Of each
`window` consecutive k-grams the one with the least hash is chosen, the rightmost of
ties; minima of windows are found by doubling too, on places, so places have no limit but
an array's. Two texts that share window + k - 1 consecutive words share a fingerprint hash.

A text with fewer than k words has one gram of all its words; fewer than `window` grams are one window;
a text without words (null, empty) has the empty fingerprint. Two empty fingerprints are
alike to 1. Rows with a null id come first in the order of ids, rows that repeat an id
follow each other by text. Other columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WINDOW = 5, 16
# Two primes under 2 ** 31, so that products fit, and a base in each field.
FIELDS = ((2147483647, 1103515245), (2147483629, 69069069))
#: Space and the characters 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
#: Most places at which the order of ids is cut; they are sent to every task.
MOST_CUTS = 8192


def bind(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pair(a: Column, b: Column) -> Column:
    """Two numbers under 2 ** 31 as one."""
    return F.shiftleft(a, 31).bitwiseOR(b)


def joined(left: Column, right: Column, length: int) -> Column:
    """The hash of a run of words followed by one of `length` words."""
    low = (1 << 31) - 1
    (p, x), (q, y) = ((p, pow(base, length, p)) for p, base in FIELDS)
    return pair((F.shiftright(left, 31) * F.lit(x).cast("long") + F.shiftright(right, 31)) % p, (left.bitwiseAND(low) * F.lit(y).cast("long") + right.bitwiseAND(low)) % q)


def rolled(h: Column, k: int) -> Column:
    """The hashes of each k consecutive words, of an array of words' hashes (k or more)."""

    def appended(left: Column, right: Column, have: int, more: int) -> Column:
        """Hashes of `have` words, each followed by `more` words."""
        return F.transform(F.slice(left, F.lit(1), F.size(left) - more), lambda x, i: joined(x, F.get(right, i + have), more))

    def go(power: Column, m: int, out: Column | None, have: int) -> Column:
        """power: the hashes of m words; out: those of `have` words, as many as the bits of k below m say."""

        def on(done: Column | None, n: int) -> Column:
            return done if n == k else bind(appended(power, power, m, m), lambda twice: go(twice, 2 * m, done, n))

        if not k & m:
            return on(out, have)
        return on(power, m) if out is None else bind(appended(out, power, have, m), lambda done: on(done, have + m))

    return go(h, 1, None, 0)


def least_places(v: Column, window: int) -> Column:
    """The place of the least value of each `window` consecutive ones, the rightmost of ties; of an array of `window` or more."""

    def doubled(at: Column, have: int) -> Column:
        if have == window:
            return at
        step = min(have, window - have)  # windows may overlap: a least value stays one
        return bind(F.transform(F.slice(at, F.lit(1), F.size(at) - step), lambda a, i: bind(F.get(at, i + step), lambda b: F.when(F.get(v, b) <= F.get(v, a), b).otherwise(a))), lambda x: doubled(x, have + step))

    return bind(F.sequence(F.lit(0), F.size(v) - 1), lambda at: doubled(at, 1))


CHOICES = "array<struct<hash:bigint,place:int>>"


def selected(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The chosen grams of a text, in text order; array<struct<hash, place>>."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))

    def word(w: Column) -> Column:
        return bind(F.xxhash64(w), lambda h: pair(F.pmod(h, F.lit(FIELDS[0][0])), F.pmod(F.shiftrightunsigned(h, 32), F.lit(FIELDS[1][0]))))

    def grams(h: Column) -> Column:
        few = F.aggregate(h, F.size(h).cast("long"), lambda acc, w: joined(acc, w, 1))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, F.array(few)).otherwise(rolled(h, k))

    def least(v: Column) -> Column:
        last = F.size(v) - 1
        whole = F.aggregate(F.sequence(F.lit(0), last), F.lit(0), lambda acc, i: F.when(F.get(v, i) <= F.get(v, acc), i).otherwise(acc))
        places = F.when(F.size(v) < window, F.array(whole)).otherwise(F.array_distinct(least_places(v, window)))
        return F.when(F.size(v) == 0, F.array().cast(CHOICES)).otherwise(F.transform(places, lambda i: F.struct(F.get(v, i).alias("hash"), i.alias("place"))))

    return bind(bind(F.transform(words, word), grams), least)


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: x.getField("hash")))


def as_text(chosen: Column) -> Column:
    """`hash@place` of each choice, joined by spaces: hash in hex, place in words."""
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lower(F.hex(x.getField("hash"))), F.lit("@"), x.getField("place").cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of distinct hashes."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union).cast("double")


def with_next(df: DataFrame, id_col: str, carried: list[str], each: int = 600) -> DataFrame:
    """df and, as next_<column>, the carried columns of the row that follows by id; the first follows the last.

    Quantiles of the ids, which are ids themselves, cut their order into buckets of
    about `each` rows. The first row of a bucket also goes to the bucket before as its
    end mark, so that buckets need nothing of each other. carried[0] breaks ties of ids.
    """
    n = df.count()
    parts = int(min(MOST_CUTS, max(1, n // each)))
    row = df.agg(F.min(id_col).alias("low"), F.sum(F.col(id_col).isNull().cast("int")).alias("nulls"), F.percentile_approx(id_col, [i / parts for i in range(1, parts)] or [0.5], 100 * parts).alias("cuts")).first()
    cuts = sorted({c for c in (row["cuts"] or []) if row["low"] is not None and c > row["low"]}) if parts > 1 else []
    ids = F.col(id_col)
    held = F.array(*map(F.lit, cuts)).cast("array<bigint>") if len(cuts) < 2 else F.lit(cuts).cast("array<bigint>")
    steps = [1 << i for i in range(max(1, len(cuts).bit_length()))][::-1]
    found = F.aggregate(F.lit(steps), F.lit(0), lambda p, s: F.when(F.get(held, p + s - 1) <= ids, p + s).otherwise(p)) if cuts else F.lit(0)
    first = ids.isNull() if row["nulls"] else ids == F.lit(row["low"])
    rows = df.withColumn("_bucket", found)
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("mark"), F.lit(0).alias("wrap"))
    before = F.struct((F.col("_bucket") - 1).alias("bucket"), F.lit(True).alias("mark"), F.lit(0).alias("wrap"))
    around = F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(True).alias("mark"), F.lit(1).alias("wrap"))
    begins = (F.get(held, F.col("_bucket") - 1) == ids) if cuts else F.lit(False)
    rows = rows.withColumn("_at", F.explode(F.concat(F.array(own), F.when(F.coalesce(begins & (F.col("_bucket") > 0), F.lit(False)), F.array(before)).otherwise(F.expr("slice(array(%s), 1, 0)" % "named_struct('bucket', 0, 'mark', true, 'wrap', 0)")), F.when(F.coalesce(first, F.lit(False)), F.array(around)).otherwise(F.expr("slice(array(%s), 1, 0)" % "named_struct('bucket', 0, 'mark', true, 'wrap', 0)")))))
    rows = rows.withColumns({"_bucket": F.col("_at.bucket"), "_mark": F.col("_at.mark"), "_wrap": F.col("_at.wrap")}).drop("_at")
    order = Window.partitionBy("_bucket").orderBy("_wrap", F.asc_nulls_first(id_col), carried[0])
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where(~F.col("_mark")).drop("_bucket", "_mark", "_wrap")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text (its last half gives way to the start of the next text)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("chosen", selected(F.col("text"), k, window))
    rows = with_next(rows, "doc_id", ["text", "chosen"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "chosen", edited.alias("edited"), hashes(F.col("next_chosen")).alias("of_next"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "chosen", "of_next", selected(F.col("edited"), k, window).alias("edited_chosen"))

    def compared(x: Column) -> Column:
        return bind(hashes(F.col("chosen")), lambda own: F.struct(likeness(own, hashes(x.getField("e"))).alias("near_edited"), likeness(own, x.getField("n")).alias("near_next")))

    both = bind(F.struct(F.col("edited_chosen").alias("e"), F.col("of_next").alias("n")), lambda x: F.struct(as_text(x.getField("e")).alias("fingerprint"), compared(x).alias("near")))
    rows = rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("chosen")).alias("fingerprint"), both.alias("b"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", F.col("b.fingerprint").alias("edited_fingerprint"), F.col("b.near.near_edited").alias("near_edited"), F.col("b.near.near_next").alias("near_next"))
