"""Document fingerprints by winnowing, in DataFrame functions only.

A text's units are its words; where scripts have no blanks, and in very long
words, its characters.  The hash of ``k`` units is the Rabin-Karp polynomial
of their hashes modulo a prime.  An array function has no running value, so
the hash does not roll unit by unit: those of two, four, ... units are made
from two of half the length each, for all positions at once, which gives the
rolling hash's values in ``log k`` steps.  Of every ``window`` consecutive
hashes the least is chosen, of equal ones the rightmost, and kept with its
position.  Any passage of ``window + k - 1`` units that two texts share leaves
a common hash in both fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .store import shuffle_partitions

#: Units a k-gram has, and hashes a window.
K = 5
WINDOW = 4
#: Modulus and base of the polynomial: products stay below 2**62.
PRIME = (1 << 31) - 1
BASE = 1_000_003
#: Low bits of a packed hash for the position; the 31 bits of the hash stand above them.
POSITION_BITS = 32
_MASK = (1 << POSITION_BITS) - 1

WORDS = r"[\x20\x09-\x0D]+"
#: Letters of scripts that set no blanks between words, and words so long that their characters are the units.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"
LONG_WORD = 64


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _window_minima(packed: Column, window: int) -> Column:
    """Least packed value of every full window; of all values where there are fewer."""
    steps, width = [], 1
    while width * 2 <= window:
        steps.append(width)
        width *= 2
    if width < window:
        steps.append(window - width)

    def least_of_two(values: Column, step: int) -> Column:
        return let(values, lambda m: F.transform(m, lambda x, i: F.least(x, F.get(m, i + step))))

    out = packed
    for step in steps:
        out = least_of_two(out, step)
    return let(out, lambda m: F.slice(m, 1, F.greatest(F.size(m) - (window - 1), F.least(F.size(m), F.lit(1)))))


def units(text: Column) -> Column:
    """The words of a text; letters of unspaced scripts, and those of words of more than ``LONG_WORD`` characters, one by one."""
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)

    def words_of(t: Column) -> Column:
        words = F.filter(F.split(t, WORDS), lambda w: w != "")
        single = lambda w: F.when(F.length(w) > LONG_WORD, F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))
        return F.when(t.rlike(rf"[^\x20\x09-\x0D]{{{LONG_WORD + 1}}}"), F.flatten(F.transform(words, single))).otherwise(words)

    return let(spaced, words_of)


def gram_hashes(hashes: Column, k: int) -> Column:
    """The polynomial of every ``k`` consecutive hashes; that of all where there are fewer, none of none."""

    def joined(left: Column, right: Column, length: int, shift: int) -> Column:
        """Grams of ``shift`` units followed by grams of ``length``, from those of either length at every position."""
        power = pow(BASE, length, PRIME)
        return let(right, lambda r: F.transform(F.slice(left, 1, F.greatest(F.size(r) - shift, F.lit(0))), lambda x, i: (x * power + F.get(r, i + shift)) % PRIME))

    def of(length: int, one: Column) -> Column:
        if length == 1:
            return one
        if length % 2:
            return joined(of(length - 1, one), one, 1, length - 1)
        return let(of(length // 2, one), lambda half: joined(half, half, length // 2, length // 2))

    short = F.array(F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: (acc * BASE + h) % PRIME))
    return F.when(F.size(hashes) >= k, of(k, hashes)).when(F.size(hashes) > 0, short).otherwise(hashes)


def fingerprint(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The chosen hashes of a text in order of position, each packed with its position into one ``long``.

    A text of fewer than ``k`` units has one k-gram of all its units, one
    without any none.
    """

    def packed(g: Column) -> Column:
        # least hash first; of equal hashes the larger position has the smaller value
        return F.transform(g, lambda h, i: F.shiftleft(h, POSITION_BITS).bitwiseOR(F.lit(_MASK) - i.cast("long")))

    hashes = F.transform(units(F.coalesce(text, F.lit(""))), lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME).cast("long")))
    chosen = let(let(let(hashes, lambda h: gram_hashes(h, k)), packed), lambda p: _window_minima(p, window))
    # neighbouring windows mostly choose the same k-gram
    return let(chosen, lambda c: F.filter(c, lambda x, i: F.coalesce(x != F.get(c, i - 1), F.lit(True)) | (i == 0)))


def hashes_of(packed: Column) -> Column:
    """The distinct hashes without their positions."""
    return F.array_distinct(F.transform(packed, lambda x: F.shiftright(x, POSITION_BITS)))


def written(packed: Column) -> Column:
    """``hash@position`` of each, comma-joined; the hash in hexadecimal."""
    return F.array_join(
        F.transform(packed, lambda x: F.concat(F.hex(F.shiftright(x, POSITION_BITS)), F.lit("@"), (F.lit(_MASK) - x.bitwiseAND(F.lit(_MASK))).cast("string"))), ","
    )


def likeness(a: Column, b: Column) -> Column:
    """Common hashes over all hashes of two fingerprints; 1 where both are empty."""

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        every = F.size(x) + F.size(y) - both
        return F.when(every == 0, F.lit(1.0)).otherwise(both / every)

    return let(hashes_of(a), lambda x: let(hashes_of(b), lambda y: share(x, y)))


def dealt_in_order(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """Rows dealt so that a window sees each before the next by ascending ``doc_id``, the last before the first.

    Guests (``_guest`` above 0) are there to be seen and must be dropped after.

    Rows of equal ``doc_id`` follow each other by text, those without one come
    first.  Rows are dealt to ranges of ``doc_id`` whose bounds are values of
    the column itself, so the first row of a range is known to carry its bound
    and is also sent, as a guest, to the range before.  No task sees more than
    its range; the number of bounds is that of the shuffle partitions.
    """
    spark = docs.sparkSession
    n = min(4 * shuffle_partitions(spark), 8192)
    shares = [i / n for i in range(n)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 10 * n).alias("b"), F.min("doc_id").alias("m"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    bounds = sorted({*(found["b"] or []), *([found["m"]] if found["m"] is not None else [])})
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    edges = F.lit(bounds) if bounds else F.array().cast("array<long>")
    # bounds at or below doc_id, by bisection; 0 without doc_id
    place = F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when((at + step <= len(bounds)) & (F.get(edges, at + step - 1) <= F.col("doc_id")), at + step).otherwise(at),
    )
    last = len(bounds)
    first_of_all = F.col("doc_id").isNull() if found["nulls"] else F.coalesce(F.col("doc_id") == F.lit(found["m"]), F.lit(False))
    at_bound = (F.col("_range") > 0) & (F.get(edges, F.col("_range") - 1) == F.col("doc_id"))
    placed = docs.withColumn("_range", place)
    home = F.struct(F.col("_range").alias("range"), F.lit(0).alias("guest"))
    before = F.when(at_bound & (F.col("_range") > (0 if found["nulls"] else 1)), F.struct((F.col("_range") - 1).alias("range"), F.lit(1).alias("guest")))
    round_ = F.when(first_of_all, F.struct(F.lit(last).alias("range"), F.lit(2).alias("guest")))
    sent = placed.withColumn("_to", F.explode(F.filter(F.array(home, before, round_), lambda x: x.isNotNull())))
    sent = sent.withColumns({"_range": F.col("_to.range"), "_guest": F.col("_to.guest")}).drop("_to")
    order = Window.partitionBy("_range").orderBy("_guest", F.asc_nulls_first("doc_id"), "text")
    dealt = sent.repartition("_range")
    return dealt, order


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprint of each text and of its edited text, and how alike they are.

    ``docs`` has ``doc_id`` and ``text``; other columns play no part.  The
    edited text has the last ``floor(n_chars / 2)`` code points replaced by as
    many (or all) of the first of the next document.  Returns ``doc_id``,
    ``n_chars``, ``edited``, ``chosen`` and ``edited_chosen`` (packed hashes
    and positions), ``near_edited`` and ``near_next``.

    A null text is an empty one, whose fingerprint is empty; two empty
    fingerprints have likeness 1.  Rows without ``doc_id`` come first; repeated
    rows follow each other, so that each is the next of the one before.  A
    single row is its own next; an empty table gives an empty result.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dealt, order = dealt_in_order(plain)
    own = dealt.withColumn("chosen", fingerprint(F.col("text"), k, window))
    paired = own.withColumns({"next_text": F.lead("text").over(order), "next_chosen": F.lead("chosen").over(order)}).where("_guest = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = paired.withColumns(
        {"n_chars": F.length("text").cast("long"), "edited": F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))}
    )
    made = edited.withColumn("edited_chosen", fingerprint(F.col("edited"), k, window))
    return made.select(
        "doc_id", "n_chars", "edited", "chosen", "edited_chosen", likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"), likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next")
    )


def digest(made: DataFrame) -> DataFrame:
    """The fingerprints as text and the edited text as its SHA-256."""
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("chosen")).alias("fingerprint"), written(F.col("edited_chosen")).alias("edited_fingerprint"), "near_edited", "near_next"
    )
