"""Arithmetic recognition: from raw text to corrected tokens, a mean and a confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions import let
from glyphmill.functions.distance import similarity, stripped

# The markup patterns that recognizers hallucinate, in the order in which they are tried.
MARKUP = (
    r"\\frac\{[^}]*\}\{[^}]*\}", r"\\frac", r"\\sqrt\{[^}]*\}", r"\\sqrt", r"\\times", r"\\div", r"\\cdot", r"\\ldots", r"\\dots", r"\\pm", r"\\mp", r"\\leq", r"\\geq", r"\\neq", r"\\approx", r"\\sum", r"\\prod", r"\\int", r"\\lim", r"\\infty",
    r"\\alpha", r"\\beta", r"\\gamma", r"\\delta", r"\\theta", r"\\pi", r"\\sigma", r"\\mu", r"\\lambda", r"\\begin\{[^}]*\}", r"\\end\{[^}]*\}", r"\\left", r"\\right", r"\\text\{[^}]*\}", r"\\mathrm\{[^}]*\}", r"\\mathbf\{[^}]*\}",
    r"\\overline\{[^}]*\}", r"\\bar\{[^}]*\}", r"\\hat\{[^}]*\}", r"\\vec\{[^}]*\}", r"\\[a-zA-Z]+",
)
MARKUP_ANY = "(?i)(" + "|".join(MARKUP) + ")"
NOISE = "{}[]$\\^_&~"
# Characters that are read for digits, and for operators.
DIGITS_FOR = {"O": "0", "o": "0", "Q": "0", "D": "0", "l": "1", "I": "1", "i": "1", "|": "1", "Z": "2", "z": "2", "E": "3", "A": "4", "S": "5", "s": "5", "G": "6", "b": "6", "T": "7", "B": "8", "g": "9", "q": "9"}
OPERATORS_FOR = {"×": "+", "x": "+", "X": "+", "*": "+", "÷": "/", "\\": "/", "—": "-", "–": "-", "−": "-", "_": "-", ":": "/", "⁼": "="}
OPERATORS = ("+", "-", "/", "=")
TOKEN = r"(\d+\.?\d*|[+\-*/=÷×])"


@dataclass(frozen=True)
class Config:
    low: int = 0
    high: int = 100
    least_numbers: int = 2
    threshold: float = 0.6
    similarity: float = 0.5


DEFAULT = Config()


def clean(text: Column) -> Column:
    """Markup and noise to blanks, look-alikes to digits and operators, everything else away, pairs of operators to the first one."""
    swaps = {c: d for c, d in (DIGITS_FOR | OPERATORS_FOR).items() if c not in NOISE}
    said = F.coalesce(text, F.lit(""))
    out = F.when(said.contains("\\"), F.regexp_replace(said, MARKUP_ANY, " ")).otherwise(said)  # every pattern starts with a backslash
    out = F.translate(out, NOISE, " " * len(NOISE))
    out = F.translate(out, "".join(swaps), "".join(swaps.values()))
    out = stripped(F.regexp_replace(out, r"(?U)\s+", " "))
    out = F.regexp_replace(out, r"(?U)[^\d+\-*/=.\s]", "")
    return stripped(F.regexp_replace(out, r"([+\-*/=])\s*([+\-*/=])", "$1"))


def tokens(cleaned: Column) -> Column:
    return F.regexp_extract_all(cleaned, F.lit(TOKEN), 1)


def _token(original: Column, corrected: Column, kind: str, confidence: Column, distance: Column) -> Column:
    return F.struct(original.alias("original"), corrected.alias("corrected"), F.lit(kind).alias("token_type"), confidence.cast("double").alias("confidence"), distance.cast("int").alias("edit_distance"))


def correct_number(token: Column, config: Config = DEFAULT) -> Column:
    """The number a token stands for (its whole part, if in range), else the most similar number of the range, else null. Ties: smaller distance, then smaller number."""
    value = F.when(token.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), token.cast("double"))
    whole = F.when(F.abs(value) < 1e15, value.cast("long"))
    exact = _token(token, whole.cast("string"), "number", F.lit(1.0), F.lit(0))
    # the numbers as folded literals; one of k characters can only be similar enough to a token of up to k / similarity characters
    names = [str(n) for n in range(config.low, config.high + 1)]
    listed = lambda k: F.array(*[F.struct(F.lit(s).alias("s"), F.lit(len(s)).alias("size"), F.lit(int(s)).alias("n")) for s in names if len(s) >= k])
    sizes = sorted(set(map(len, names)))
    need = config.similarity * F.length(token) - 1e-9
    named = F.when(need <= sizes[0], listed(sizes[0]))
    for k in sizes[1:]:
        named = named.when(need <= k, listed(k))
    far = lambda d, size: d / F.greatest(F.length(token), size) - 1
    measured = F.transform(named, lambda x: F.struct(F.levenshtein(token, x["s"]).alias("d"), x["size"].alias("size"), x["n"].alias("n")))
    best = F.array_min(F.transform(measured, lambda x: F.struct(far(x["d"], x["size"]).alias("s"), x["d"].alias("d"), x["n"].alias("n"))))
    fuzzy = let(best, lambda near: F.when(-near["s"] >= config.similarity, _token(token, near["n"].cast("string"), "number", -near["s"], near["d"])))
    # without a digit nothing is shared with any number, and the similarity is 0
    return F.when(whole.between(config.low, config.high), exact).when(token.rlike(r"\d") & (need <= sizes[-1]), fuzzy)


def correct_operator(token: Column, config: Config = DEFAULT) -> Column:
    """An allowed operator, one that the token is known to be read for, or the most similar one (the first of equals); else null."""
    known = F.create_map(*[F.lit(x) for pair in OPERATORS_FOR.items() for x in pair])[token]
    places = F.array(*[F.struct((-similarity(token, F.lit(o))).alias("s"), F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(OPERATORS)])
    near = F.array_min(places)
    fuzzy = F.when(-near["s"] >= config.similarity, _token(token, near["o"], "operator", -near["s"], F.levenshtein(token, near["o"])))
    return F.when(token.isin(*OPERATORS), _token(token, token, "operator", F.lit(1.0), F.lit(0))).when(known.isNotNull(), _token(token, known, "operator", F.lit(0.8), F.lit(1))).otherwise(fuzzy)


def correct_token(token: Column, config: Config = DEFAULT) -> Column:
    """As a number, else as an operator, else discarded."""
    bare = stripped(token)
    lost = _token(bare, F.lit(""), "discarded", F.lit(0.0), F.length(bare))
    return F.when(bare == "", lost).otherwise(F.coalesce(correct_number(bare, config), correct_operator(bare, config), lost))


def correct_all(found: Column, config: Config = DEFAULT) -> Column:
    return F.filter(F.transform(found, lambda t: correct_token(t, config)), lambda c: c["token_type"] != "discarded")


def numbers_of(corrected: Column) -> Column:
    return F.transform(F.filter(corrected, lambda c: c["token_type"] == "number"), lambda c: c["corrected"].cast("int"))


def reasons(corrected: Column, config: Config = DEFAULT) -> Column:
    """Why the tokens are no valid input; empty if they are."""
    number = lambda c: c["corrected"].cast("int")
    span = f"[{config.low}, {config.high}]"
    allowed = "[" + ", ".join(f"'{o}'" for o in OPERATORS) + "]"
    each = F.transform(corrected, lambda c: F.when((c["token_type"] == "number") & ~number(c).between(config.low, config.high), F.format_string(f"Number %d outside range {span}", number(c)))
        .when((c["token_type"] == "operator") & ~c["corrected"].isin(*OPERATORS), F.concat(F.lit("Operator '"), c["corrected"], F.lit(f"' not in allowed set {allowed}")))
        .when(c["token_type"] == "discarded", F.concat(F.lit("Discarded token: '"), c["original"], F.lit("'"))))
    n = F.size(F.filter(numbers_of(corrected), lambda x: x.between(config.low, config.high)))
    few = F.when(n < config.least_numbers, F.array(F.format_string(f"Only %d valid numbers found, need at least {config.least_numbers}", n))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.filter(each, lambda x: x.isNotNull()), few)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, total(values) / F.size(values))


def expression(numbers: Column) -> Column:
    """The mean of the numbers as text; whatever operators the input had."""
    joined = F.array_join(F.transform(numbers, lambda n: n.cast("string")), " + ")
    return F.when(F.size(numbers) > 1, F.concat(F.lit("("), joined, F.lit(") / "), F.size(numbers).cast("string"))).otherwise(joined)


def confidence(corrected: Column, numbers: Column, issues: Column, config: Config = DEFAULT) -> Column:
    """0.3 token corrections + 0.3 range and spread + 0.25 structure + 0.15 count, to four places."""
    token = F.coalesce(mean(F.transform(corrected, lambda c: c["confidence"])), F.lit(0.0))
    variance = let(F.struct(numbers.alias("v"), mean(numbers).alias("m")), lambda s: F.aggregate(s["v"], F.lit(0.0), lambda t, x: t + (x - s["m"]) * (x - s["m"])) / F.size(s["v"]))
    spread = F.sqrt(variance)
    spread = F.when(F.size(numbers) > 1, F.greatest(F.lit(0.0), 1.0 - spread / 50.0)).otherwise(0.8)
    inside = F.size(F.filter(numbers, lambda x: x.between(config.low, config.high))) / F.size(numbers)
    number = F.when(F.size(numbers) > 0, inside * 0.6 + spread * 0.4).otherwise(0.0)
    structure = F.greatest(F.lit(0.0), 1.0 - issues * 0.2)
    count = F.when(F.size(numbers) >= 3, 1.0).when(F.size(numbers) == 2, 0.7).when(F.size(numbers) == 1, 0.4).otherwise(0.0)
    return F.round(token * 0.3 + number * 0.3 + structure * 0.25 + count * 0.15, 4)


# What must not be in raw text, in order; a name may come twice.
BANNED = ((r"\\frac", "LaTeX fraction"), (r"\\ldots", "LaTeX ellipsis"), (r"\\times", "LaTeX times"), (r"\\sqrt", "LaTeX sqrt"), (r"\\sum", "LaTeX sum"), (r"\\int", "LaTeX integral"), (r"\\begin", "LaTeX environment"), (r"\\end", "LaTeX environment"), (r"\$", "Dollar sign (LaTeX delimiter)"), (r"\{", "Curly brace (LaTeX)"), (r"\}", "Curly brace (LaTeX)"))


def banned(raw: Column) -> Column:
    return F.filter(F.array(*[F.when(raw.rlike(p), name) for p, name in BANNED]), lambda x: x.isNotNull())


def markup_found(raw: Column) -> Column:
    """Distinct markup and structural characters of a text, sorted."""
    marks = F.filter(F.transform(F.split(raw, ""), lambda c: F.when((c != "") & F.lit(NOISE).contains(c), F.concat(F.lit("structural:"), c))), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(raw, F.lit(MARKUP_ANY), 1), marks)))
