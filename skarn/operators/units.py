"""Quantities recorded in different units, brought to common ones.

Unit words are segmented by dynamic programming over tries of prefixes, roots, endings and
exponents; where several decompositions fit, priors of the field's dimension decide. Statements
in free text are then told apart from measurements that merely mention a unit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.functions.names import name_key
from skarn.sources.tables import materialize, ship

# Prefixes (power of ten), roots (dimension, factor to the coherent unit, log prior),
# endings and exponents of unit words in the languages the notes use.
PREFIXES = {
    "k": 3, "kilo": 3, "h": 2, "hecto": 2, "da": 1, "d": -1, "deci": -1, "dezi": -1, "c": -2, "centi": -2, "zenti": -2, "centí": -2,
    "m": -3, "milli": -3, "mili": -3, "milí": -3, "µ": -6, "μ": -6, "micro": -6, "mikro": -6, "n": -9, "nano": -9,
}
ROOTS = {
    "m": ("length", 1.0, -0.5), "metre": ("length", 1.0, 0.0), "meter": ("length", 1.0, 0.0), "metro": ("length", 1.0, 0.0), "mètre": ("length", 1.0, 0.0), "si": ("length", 1.0, -1.0),
    "in": ("length", 0.0254, -1.0), "inch": ("length", 0.0254, 0.0), "zoll": ("length", 0.0254, 0.0), "pulgada": ("length", 0.0254, 0.0), "pouce": ("length", 0.0254, 0.0), '"': ("length", 0.0254, -0.5), "″": ("length", 0.0254, -0.5),
    "ft": ("length", 0.3048, 0.0), "foot": ("length", 0.3048, 0.0), "feet": ("length", 0.3048, 0.0), "fuß": ("length", 0.3048, 0.0), "yd": ("length", 0.9144, 0.0), "yard": ("length", 0.9144, 0.0),
    "g": ("mass", 1e-3, 0.0), "gram": ("mass", 1e-3, 0.0), "lb": ("mass", 0.45359237, 0.0), "oz": ("mass", 0.028349523, 0.0),
    "s": ("time", 1.0, -0.5), "sec": ("time", 1.0, 0.0), "second": ("time", 1.0, 0.0), "min": ("time", 60.0, 0.0), "minute": ("time", 60.0, 0.0), "h": ("time", 3600.0, -0.5), "hour": ("time", 3600.0, 0.0),
    "rad": ("angle", 1.0, 0.0), "deg": ("angle", math.pi / 180, 0.0), "degree": ("angle", math.pi / 180, 0.0), "n": ("force", 1.0, -0.5), "newton": ("force", 1.0, 0.0),
}
ENDINGS = {"": 0.0, "s": -0.1, "es": -0.1, "n": -0.2, "ern": -0.2, "e": -0.3, "maße": -0.2, "maß": -0.2, ".": -0.1}
EXPONENTS = {"": 1, "2": 2, "²": 2, "^2": 2, "3": 3, "³": 3, "^3": 3}
#: Units that a length may turn out to be in, with metres each; units that only a statement gives;
#: and the log prior of a wrong dimension.
LENGTHS = {"m": 1.0, "mm": 0.001, "cm": 0.01, "in": 0.0254, "ft": 0.3048}
STATED_ONLY = {"yd": 0.9144, "km": 1e3, "hm": 100.0, "dam": 10.0, "dm": 0.1, "um": 1e-6, "nm": 1e-9}
WRONG_DIMENSION = -8.0


def _trie(words: dict) -> dict:
    top: dict = {}
    for w, value in words.items():
        at = top
        for ch in w:
            at = at.setdefault(ch, {})
        at[""] = value
    return top


_TRIES = [_trie(PREFIXES | {"": 0}), _trie(ROOTS), _trie(ENDINGS), _trie(EXPONENTS)]


def _matches(trie: dict, text: str, at: int) -> Iterator[tuple[int, object]]:
    while True:
        if "" in trie:
            yield at, trie[""]
        if at == len(text) or text[at] not in trie:
            return
        trie, at = trie[text[at]], at + 1


@lru_cache(maxsize=100_000)
def parse_unit(word: str, dimension: str = "length") -> tuple[float, str, int, float] | None:
    """(factor to the coherent unit, dimension, exponent, score) of the best segmentation of a
    word as prefix + root + ending + exponent; None where no segmentation covers it.

    best[i] holds, for each stage, the best way to have read word[:i]: the stages follow one
    another, so each position is extended over each trie once. A root of another dimension than
    the field's, or an exponent that the field does not have, costs WRONG_DIMENSION, so that of
    "min" a length field reads milli-inch and a time field minutes only if nothing fits better.
    """
    text = word.strip().lower()
    ways: dict[tuple[int, int], tuple[float, float, str, int]] = {(0, 0): (0.0, 1.0, "", 1)}
    for stage, trie in enumerate(_TRIES):
        for at in range(len(text) + 1):
            have = ways.get((stage, at))
            if have is None:
                continue
            score, factor, dim, power = have
            for end, value in _matches(trie, text, at):
                if stage == 0:
                    new = (score - (0.4 if value else 0.0), factor * 10.0**value, dim, power)
                elif stage == 1:
                    d, f, prior = value
                    new = (score + prior + (0.0 if d == dimension else WRONG_DIMENSION), factor * f, d, power)
                elif stage == 2:
                    new = (score + value, factor, dim, power)
                else:
                    new = (score + (0.0 if value == 1 else WRONG_DIMENSION), factor**value, dim, value)
                if (stage + 1, end) not in ways or ways[stage + 1, end][0] < new[0]:
                    ways[stage + 1, end] = new
    best = ways.get((4, len(text)))
    return (best[1], best[2], best[3], best[0]) if best and text else None


def unit_name(metres: float) -> str | None:
    """The name of a unit of so many metres: one of LENGTHS or STATED_ONLY, else its factor for
    a power of ten; None for others, as prefixes do not go with inches or feet."""
    named = next((k for k, f in (LENGTHS | STATED_ONLY).items() if abs(metres / f - 1) < 1e-6), None)
    power = round(math.log10(metres))
    return named or (f"1e{power} m" if abs(metres / 10.0**power - 1) < 1e-6 else None)


def length_unit(word: str) -> str | None:
    """The `unit_name` of a word for a unit of length, else None."""
    u = parse_unit(word)
    return unit_name(u[0]) if u is not None and u[1] == "length" and u[2] == 1 else None


_TOKEN = re.compile(r"\d+(?:[.,/:]\d+)*|[^\W\d_]+|[\"″]|\S")
_PARTS = {"thousandth": 0.001, "hundredth": 0.01}
_FILLERS = {"of", "a", "an", "the", "in"}
# Words before a unit that is not in force: another one is, or was.
_DENIED = {"not", "never", "no", "without", "nicht", "kein", "keine"}
_FORMER = {"from", "was", "were", "formerly", "previously", "originally", "once", "instead", "früher", "antes"}


def read_statement(text: str | None) -> tuple[str | None, list[float] | None, str | None, float | None, str | None]:
    """(stated unit, three numbers, their unit, first number with a unit, its unit) of a note.

    A unit that follows a number measures something and states nothing, but for "1 unit = 1 cm".
    A unit after "to" or "now" is the one in force; one after "from", "was" or "formerly" no longer
    is, and one that is denied ("not in mm") is none.
    "in" is a word unless it stands after a number, in brackets or alone.
    """
    if text is None or not text.strip():
        return None, None, None, None, None
    tokens = _TOKEN.findall(text.lower().replace("×", "x"))
    low = " ".join(tokens)
    stated: list[tuple[int, str]] = []
    numbers: list[tuple[int, float]] = []
    value = value_unit = dims = dims_unit = None
    for i, t in enumerate(tokens):
        if t[0].isdigit():
            if ":" in t:
                a, _, b = t.partition(":")
                unit = next((k for k, f in LENGTHS.items() if b == "1" and abs(float(a.replace(",", ".")) * f - 1) < 1e-9), None) if re.fullmatch(r"[\d.,]+", a) else None
                if unit and "unscaled" in tokens:
                    stated.append((1, unit))
            else:
                try:
                    numbers.append((i, float(t.replace(",", "."))))
                except ValueError:
                    numbers.append((i, math.nan))
            continue
        before = tokens[i - 1] if i else ""
        after = tokens[i + 1] if i + 1 < len(tokens) else ""
        if t.rstrip("s") in _PARTS:
            rest = [w for w in tokens[i + 1 : i + 5] if w not in _FILLERS]
            if rest and (u := parse_unit(rest[0])) and u[1] == "length":
                stated += [(1, k) for k in [unit_name(u[0] * _PARTS[t.rstrip("s")])] if k]
            continue
        unit = length_unit(t)
        if unit is None or (i >= 2 and before in _FILLERS and any(w.rstrip("s") in _PARTS for w in tokens[max(0, i - 3) : i])):
            continue
        if before and before[0].isdigit() and ":" not in before:
            n = numbers[-1][1] if numbers else math.nan
            if "=" in tokens[max(0, i - 2) : i] and "unit" in tokens:
                stated.append((1, unit))
            elif value is None and n == n:
                value, value_unit = n, unit
            if len(numbers) >= 3 and all(tokens[a + 1 : b] in (["x"], ['"', "x"], ["″", "x"]) for (a, _), (b, _) in zip(numbers[-3:], numbers[-2:])):
                dims, dims_unit = [x for _, x in numbers[-3:]], unit
            continue
        if t == "in" and not (len(tokens) == 1 or before in "([" and before and after in (")", "]", ".")):
            continue
        if t == "m" and before == "'":
            continue
        lead = next((w for w in reversed(tokens[max(0, i - 3) : i]) if w not in _FILLERS and w not in "([:"), "")
        if lead in _DENIED or lead in _FORMER or lead == "of" and i >= 2 and tokens[i - 2] == "instead":
            continue
        if before in ("to", "now", "into"):
            stated.append((2, unit))
        else:
            stated.append((1, unit))
    top = max((r for r, _ in stated), default=0)
    units = list(dict.fromkeys(u for r, u in stated if r == top))
    if len(units) > 1:  # the one next to a word for the box, if there is just one
        near = [u for u in units if re.search(rf"(?:box|bbox|aabb|extents?|dims?|dimensions|lengths?|sizes?)\W+(?:\w+\W+){{0,2}}{re.escape(u)}\b", low)]
        units = near if len(near) == 1 else []
    return (units[0] if units else None), dims, dims_unit, value, value_unit


_READING = T.StructType([T.StructField("stated", T.StringType()), T.StructField("dims", T.ArrayType(T.DoubleType())), T.StructField("dims_unit", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("value_unit", T.StringType())])


@F.pandas_udf(_READING)
def _read(texts: pd.Series) -> pd.DataFrame:
    code, distinct = pd.factorize(texts, use_na_sentinel=False)  # each distinct text of a batch is read once
    read = [read_statement(t if isinstance(t, str) else None) for t in distinct]
    return pd.DataFrame([read[c] for c in code], columns=["stated", "dims", "dims_unit", "value", "value_unit"])


# The bounds of the size classes in metres, and other words for them.
SCALE_BOUNDS = (("unit_bug", 50.0, False), ("huge", 2.5, False), ("fullsize", 1.0, True), ("tabletop", 0.3, True))
CLASS_WORDS = {"compact": "compact", "small": "compact", "tabletop": "tabletop", "fullsize": "fullsize", "huge": "huge", "verylarge": "huge", "unitbug": "unit_bug"}
#: What is believed before anything is counted, worth PSEUDO entries of each kind: median and
#: spread of the longest side in metres, shares of units where the source states none, share of
#: the stated unit where it does, shares of class words that name the class of the metres, of the
#: bare numbers and of neither, and share of records of one model that agree in size.
SIZE_PRIOR = (0.85, 1.1)
UNIT_PRIOR = {"m": 0.90, "mm": 0.05, "cm": 0.02, "in": 0.02, "ft": 0.01}
STATED_PRIOR = 0.9
CLASS_PRIOR = (0.6, 0.35, 0.05)
KIN_PRIOR = 0.95
PSEUDO = 20.0
#: Rounds in which the shares of units are fitted to all entries.
ROUNDS = 2
#: Two records of one model agree in size within this log ratio.
SAME_SIZE = 0.03


def scale_class(longest: Column) -> Column:
    """The size class of a longest side in metres; unknown for null or zero."""
    out = F.when(longest.isNull() | (longest <= 0), "unknown")
    for name, bound, closed in SCALE_BOUNDS:
        out = out.when((longest >= bound) if closed else (longest > bound), name)
    return out.otherwise("compact")


def longest_side(box: Column) -> Column:
    """The largest finite number of a box, null for a null, empty or all-zero box."""
    most = F.array_max(F.filter(box, lambda x: x.isNotNull() & ~F.isnan(x) & (x < float("inf"))))
    return F.when(most > 0, most)


def _factor(unit: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in (LENGTHS | STATED_ONLY).items() for x in kv])[unit]
    return F.coalesce(named, F.split_part(unit, F.lit(" "), F.lit(1)).try_cast("double"))


def _unit_of_ratio(metres: Column, numbers: Column) -> Column:
    """The unit of LENGTHS that turns numbers into metres, null if none does within SAME_SIZE."""
    out = F.lit(None).cast("string")
    for u, f in LENGTHS.items():
        out = F.when(F.abs(F.ln(metres) - F.ln(numbers * f)) < SAME_SIZE, u).otherwise(out)
    return out


def _decimals(box: Column) -> Column:
    """How many decimals the numbers of a box are written with, at most 6."""

    def whole(scale: float) -> Column:
        return F.forall(box, lambda x: x.isNull() | (F.abs(x * scale - F.rint(x * scale)) < 1e-6 * F.greatest(F.lit(1.0), F.abs(x * scale))))

    out = F.lit(6)
    for d in range(5, -1, -1):
        out = F.when(whole(10.0**d), d).otherwise(out)
    return out


def common_units(entry: DataFrame, source_ref: DataFrame, groups: DataFrame) -> DataFrame:
    """entry_id, unit, evidence, extent_m, longest_m, size_class for each entry with a box.

    entry: one row per entry_id with source, notes, scale_class, aabb_extent_m; source_ref:
    source, length_unit, remark; groups: (entry_id, group_id). What an entry says of itself
    decides (evidence 'stated' for its note, 'measured' where a size with a unit, in its note or
    class, fits the numbers). Else the unit of LENGTHS of the largest posterior is taken
    ('inferred'): its share among entries whose source states the same, or nothing, times the
    likelihoods of the size, of the class word (which may have been derived from metres or from
    the bare numbers), of the number of decimals, and of the size that stated entries of the same
    group have. All likelihoods are counted over the entries that state or measure their unit;
    the shares of units, which those would bias, over all entries by their posteriors
    (expectation maximisation, ROUNDS times). Entries whose box is null, empty, zero or has no
    finite number are left out; null notes, classes and sources are no evidence; ties go to the
    earlier unit of LENGTHS. A stated unit that is not in LENGTHS comes out as it is stated.
    """
    ship(entry.sparkSession)
    box = F.col("aabb_extent_m")
    e = entry.select("entry_id", name_key(F.col("source")).alias("source"), F.col("aabb_extent_m"), longest_side(box).alias("most"), name_key(F.col("scale_class")).alias("word"), F.col("notes"), F.col("scale_class"))
    e = e.filter("most is not null").withColumns({"note": F.when(F.col("notes").rlike(r"\S"), _read("notes")), "sized": F.when(F.col("scale_class").rlike(r"\d"), _read("scale_class"))})
    e = e.select(
        "entry_id", "source", "aabb_extent_m", "most", "word", F.col("note.stated").alias("stated"), _decimals(box).alias("decimals"),
        _unit_of_ratio(F.array_max("note.dims") * _factor(F.col("note.dims_unit")), F.col("most")).alias("by_dims"),
        _unit_of_ratio(F.col("sized.value") * _factor(F.col("sized.value_unit")), F.col("most")).alias("by_class"),
    )
    e = e.withColumns({"own": F.coalesce("stated", "by_dims", "by_class"), "evidence": F.when(F.col("stated").isNotNull(), "stated").when(F.coalesce("by_dims", "by_class").isNotNull(), "measured").otherwise("inferred")})
    e = materialize(e.join(groups.select("entry_id", "group_id"), "entry_id", "left").drop("stated", "by_dims", "by_class"), "units")

    ref = source_ref.select(name_key(F.col("source")).alias("source"), "length_unit", "remark").withColumns({"a": _read("length_unit"), "b": _read("remark")})
    ref = ref.groupBy("source").agg(F.min(F.coalesce("a.stated", "b.stated")).alias("source_unit"))
    own = F.when(F.col("own").isin(*LENGTHS), F.col("own"))
    metres_own = F.ln(F.col("most") * _factor(F.col("own")))
    sizes = e.filter("own is not null").groupBy("group_id").agg(F.sum(metres_own).alias("kin_sum"), F.count("*").alias("kin_n"))
    word = F.coalesce(F.create_map(*[F.lit(x) for kv in CLASS_WORDS.items() for x in kv])[F.col("word")], F.lit(""))
    e = materialize(e.join(ref, "source", "left").join(sizes, "group_id", "left").withColumn("word", word), "evidence")

    # counted over entries of known unit: one row, and at most len(LENGTHS) x 7 counts
    real = F.col("most") * _factor(F.col("own"))
    is_real, is_bare = scale_class(real) == F.col("word"), scale_class(F.col("most")) == F.col("word")
    telling = (F.col("word") != "") & (scale_class(real) != scale_class(F.col("most")))
    others = (F.col("kin_sum") - F.ln(real)) / F.greatest(F.col("kin_n") - 1, F.lit(1))
    akin = F.col("kin_n") > 1
    k = e.filter("own is not null").agg(
        F.count("*").alias("n"), F.sum(F.ln(real)).alias("s"), F.sum(F.ln(real) * F.ln(real)).alias("ss"),
        F.count_if(telling & is_real).alias("real"), F.count_if(telling & is_bare).alias("bare"), F.count_if(telling & ~is_real & ~is_bare).alias("neither"),
        F.count_if(akin).alias("kin"), F.count_if(akin & (F.abs(F.ln(real) - others) < SAME_SIZE)).alias("same"),
    ).first()
    middle, spread = math.log(SIZE_PRIOR[0]), SIZE_PRIOR[1]
    mean = ((k.s or 0.0) + PSEUDO * middle) / (k.n + PSEUDO)
    spread = math.sqrt(max(((k.ss or 0.0) + PSEUDO * (spread**2 + middle**2)) / (k.n + PSEUDO) - mean**2, 0.01))
    told = k.real + k.bare + k.neither + PSEUDO
    by_word = [(n + PSEUDO * q) / told for n, q in zip((k.real, k.bare, k.neither), CLASS_PRIOR)]
    agree = (k.same + PSEUDO * KIN_PRIOR) / (k.kin + PSEUDO)
    # a density over the log ratio: within SAME_SIZE, or anywhere in the spread of sizes
    kin_score = (math.log(agree / (2 * SAME_SIZE)), math.log((1 - agree) / (4 * spread)))
    seen = {(r.own, r.decimals): r.n for r in e.filter("own is not null").groupBy("own", "decimals").agg(F.count("*").alias("n")).collect()}
    total = {u: sum(n for (x, _), n in seen.items() if x == u) for u in LENGTHS}

    likely = []
    for u, f in LENGTHS.items():
        metres = F.col("most") * f
        size = -0.5 * F.pow((F.ln(metres) - mean) / spread, 2)
        fits = lambda x: F.when(scale_class(x) == F.col("word"), 1.0).otherwise(0.0)
        named = F.when(F.col("word") == "", 0.0).otherwise(F.ln(by_word[0] * fits(metres) + by_word[1] * fits(F.col("most")) + by_word[2] / len(SCALE_BOUNDS)))
        written = F.lit(0.0)
        for d in range(7):
            written = F.when(F.col("decimals") == d, math.log((seen.get((u, d), 0) + 0.05) / (total[u] + 0.5))).otherwise(written)
        kin = F.when(F.col("kin_n").isNull(), 0.0).when(F.abs(F.ln(metres) - F.col("kin_sum") / F.col("kin_n")) < SAME_SIZE, kin_score[0]).otherwise(kin_score[1])
        likely.append(F.when(F.col("own").isNull(), size + named + written + kin).otherwise(F.when(own == u, 0.0).otherwise(-50.0)))
    e = materialize(e.select("entry_id", "aabb_extent_m", "most", "own", "evidence", "source_unit", F.array(*likely).alias("likely")), "likely")

    shares, stated = dict(UNIT_PRIOR), STATED_PRIOR
    for _ in range(ROUNDS):
        weight = F.transform(_posterior(shares, stated), lambda x: F.exp(x))
        sums = e.filter("own is null or array_max(likely) = 0").select("source_unit", F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(0.0), lambda a, b: a + b)).alias("w"))
        sums = sums.groupBy("source_unit").agg(F.count("*").alias("n"), *[F.sum(F.col("w")[i]).alias(f"n{i}") for i in range(len(LENGTHS))]).collect()  # units a source can state
        free = [r for r in sums if r.source_unit is None]
        count = sum(r.n for r in free)
        shares = {u: (sum(r[f"n{i}"] for r in free) + PSEUDO * UNIT_PRIOR[u]) / (count + PSEUDO) for i, u in enumerate(LENGTHS)}
        bound = [r for r in sums if r.source_unit in LENGTHS]
        right = sum(r[f"n{list(LENGTHS).index(r.source_unit)}"] for r in bound)
        stated = (right + PSEUDO * STATED_PRIOR) / (sum(r.n for r in bound) + PSEUDO)
    score = _posterior(shares, stated)
    best = F.get(F.array(*[F.lit(u) for u in LENGTHS]), F.array_position(score, F.array_max(score)).cast("int") - 1)
    out = e.withColumn("unit", F.coalesce("own", best))
    return out.select("entry_id", "unit", "evidence", F.transform("aabb_extent_m", lambda x: x * _factor(F.col("unit"))).alias("extent_m"), (F.col("most") * _factor(F.col("unit"))).alias("longest_m")).withColumn("size_class", scale_class(F.col("longest_m")))


def _posterior(shares: dict[str, float], stated: float) -> Column:
    """Log posteriors of the LENGTHS but for a constant, from `likely` and `source_unit`."""
    out = []
    for i, u in enumerate(LENGTHS):
        prior = F.when(F.col("source_unit").isNull(), math.log(shares[u])).when(F.col("source_unit") == u, math.log(stated)).otherwise(math.log(max(1 - stated, 1e-9) * shares[u]))
        out.append(F.col("likely")[i] + prior)
    return F.array(*out)
