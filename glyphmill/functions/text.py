"""Rewriting and judging of recognized text. In every chain the order of the steps matters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.distance import stripped, words

SPACE = r"(?U)\s+"


def count_of(text: Column, what: str) -> Column:
    """How often a literal occurs (without overlaps)."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def remove_artifacts(text: Column) -> Column:
    """Hash marks to blanks, runs of three or more marks to the last one, junk at the ends away, single blanks."""
    out = F.regexp_replace(text, r"(?U)\s*#\s*", " ")
    out = F.regexp_replace(out, r"([.!?,;:]){3,}", "$1")
    out = F.regexp_replace(out, r"(?U)^[\s#*\-_=]+", "")
    out = F.regexp_replace(out, r"(?U)[\s#*\-_=]+\z", "")
    return stripped(F.regexp_replace(out, SPACE, " "))


def strip_markup(text: Column) -> Column:
    """Formula commands and braces away, without a trace."""
    out = text
    for pattern in (r"\\frac\{[^}]*\}\{[^}]*\}", r"\\ldots", r"\\times", r"\\cdot", r"\\sqrt\{[^}]*\}", r"\\sum", r"\\int", r"\\[a-zA-Z]+"):  # fixed values, in order
        out = F.regexp_replace(out, pattern, "")
    return stripped(F.regexp_replace(F.regexp_replace(out, r"[{}]", ""), SPACE, " "))


def normalize_math(text: Column) -> Column:
    """Blanks around + - =, plain * and /, and as many closing as opening parentheses."""
    out = F.translate(F.regexp_replace(text, r"(?U)\s*([+\-=])\s*", " $1 "), "×÷", "*/")
    more = count_of(out, "(") - count_of(out, ")")
    return F.concat(F.when(more < 0, F.repeat(F.lit("("), -more)).otherwise(""), out, F.when(more > 0, F.repeat(F.lit(")"), more)).otherwise(""))


def balance_braces(latex: Column) -> Column:
    """Without closing braces that nothing opened, and with those that are missing at the end."""
    parts = F.split(latex, r"\}")
    start = F.struct(F.element_at(parts, 1).alias("out"), count_of(F.element_at(parts, 1), "{").alias("depth"))
    step = lambda s, p: F.struct(F.concat(s["out"], F.when(s["depth"] > 0, "}").otherwise(""), p).alias("out"), (F.greatest(s["depth"] - 1, F.lit(0)) + count_of(p, "{")).alias("depth"))
    done = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), start, step)
    return F.concat(done["out"], F.repeat(F.lit("}"), done["depth"]))


def cleanup_latex(latex: Column) -> Column:
    out = balance_braces(stripped(latex))
    for command, after in (("frac", "{"), ("sqrt", "{"), ("sum", "_"), ("int", "_"), ("lim", "_")):
        out = F.regexp_replace(out, rf"(?U)\\{command}\s+" + ("\\{" if after == "{" else after), rf"\\{command}" + after)
    out = F.regexp_replace(out, r"(?U)\\\s+", r"\\")
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\{\s+", "{"), r"(?U)\s+\}", "}")


def postprocess_latex(latex: Column) -> Column:
    """Without enclosing dollar signs, braces balanced by their counts, no blank between a command and its brace."""
    out = stripped(latex)
    out = F.when(out.startswith("$") & out.endswith("$"), F.when(F.length(out) > 1, out.substr(F.lit(2), F.length(out) - 2)).otherwise("")).otherwise(out)
    more = count_of(out, "{") - count_of(out, "}")
    out = F.concat(F.when(more < 0, F.repeat(F.lit("{"), -more)).otherwise(""), out, F.when(more > 0, F.repeat(F.lit("}"), more)).otherwise(""))
    return F.regexp_replace(F.regexp_replace(out, r"(?U)\\frac\s*\{", r"\\frac{"), r"(?U)\\sqrt\s*\{", r"\\sqrt{")


def format_math(latex: Column, display: Column) -> Column:
    out = stripped(latex)
    for mark in ("$$", "$", "\\[", "\\]", "\\(", "\\)"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    out = stripped(out)
    return F.when(display, F.concat(F.lit("$$\n"), out, F.lit("\n$$"))).otherwise(F.concat(F.lit("$"), out, F.lit("$")))


#: Single letters that stand for digits in formulas.
SYMBOLS = (("Z", "2"), ("l", "1"), ("O", "0"), ("S", "5"), ("q", "9"), ("I", "1"))


def symbol_rules(text: Column) -> Column:
    for wrong, right in SYMBOLS:
        text = F.regexp_replace(text, rf"(?U)\b{wrong}\b", right)
    return text


#: Misspellings that recognizers make.
TYPOS = (("teh", "the"), ("hte", "the"), ("adn", "and"), ("nad", "and"), ("wiht", "with"))


def fix_typos(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?U)\s{2,}", " ")
    for wrong, right in TYPOS:
        out = F.regexp_replace(out, rf"(?iU)\b{wrong}\b", right)
    return F.regexp_replace(out, r"(?iU)\bform\b(?=\s+the)", "from")


def valid_latex(latex: Column) -> Column:
    """Not blank, no brace closes before it opens, none stays open, as many \\begin as \\end."""
    parts = F.split(latex, r"\}")
    first = count_of(F.element_at(parts, 1), "{")
    walk = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.struct(first.alias("depth"), F.lit(True).alias("ok")), lambda s, p: F.struct((s["depth"] - 1 + count_of(p, "{")).alias("depth"), (s["ok"] & (s["depth"] > 0)).alias("ok")))
    return F.coalesce((stripped(latex) != "") & walk["ok"] & (walk["depth"] == 0) & (count_of(latex, "\\begin") == count_of(latex, "\\end")), F.lit(False))


def latex_confidence(latex: Column) -> Column:
    return F.when(~valid_latex(latex), 0.1).when(latex.contains("\\unknown") | latex.contains("???"), 0.3).otherwise(0.9)


def looks_like_latex(text: Column) -> Column:
    return text.rlike(r"[\\_^{}]") & (count_of(text, "{") == count_of(text, "}"))


def is_display_math(text: Column) -> Column:
    return text.rlike(r"\\frac|\\sum|\\prod|\\int|\\lim|\\begin\{|\\matrix")


def has_repetition(text: Column) -> Column:
    """Five equal characters in a row (on one line), or three equal words in a row."""
    w = words(F.lower(text))
    beside = F.arrays_zip(w.alias("a"), F.slice(w, F.lit(2), F.size(w)).alias("b"), F.slice(w, F.lit(3), F.size(w)).alias("c"))
    thrice = F.exists(beside, lambda z: F.coalesce((z["a"] == z["b"]) & (z["a"] == z["c"]), F.lit(False)))
    return text.rlike(r"(.)\1{4,}") | thrice


def plausibility(text: Column, vocabulary: Column | None = None, least_letters: float = 0.7, least_words: float = 0.5) -> Column:
    """struct(plausible, confidence, reason); the first test that fails decides."""
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    size = F.length(F.replace(text, F.lit(" "), F.lit("")))
    ratio = letters / size
    result = lambda ok, score, why: F.struct(F.lit(ok).alias("plausible"), score.cast("double").alias("confidence"), F.lit(why).alias("reason"))
    out = F.when(stripped(text) == "", result(False, F.lit(0.0), "empty_text")).when(size == 0, result(False, F.lit(0.0), "no_characters")).when(ratio < least_letters, result(False, ratio, "low_alpha_ratio"))
    if vocabulary is not None:
        own = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b([a-zA-Z]+)\b"), 1)
        known = F.size(F.filter(own, lambda w: F.array_contains(vocabulary, w))) / F.size(own)
        out = out.when((F.size(own) > 0) & (known < least_words), result(False, known, "low_word_ratio"))
    return out.when(has_repetition(text), result(False, F.lit(0.3), "excessive_repetition")).otherwise(result(True, F.least(F.lit(1.0), ratio * 1.2), "passed"))


def forbidden(text: Column) -> Column:
    """Names of what a checked text must not hold."""
    return F.array_compact(F.array(F.when(text.contains("0"), "zero"), F.when(F.lower(text).contains("catalog"), "catalog"), F.when(text.contains(".."), "double dots")))


def zero_hallucinated(prediction: Column, truth: Column) -> Column:
    return prediction.contains("0") & ~truth.rlike(r"(?U)\d")


def solution_steps(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda x: x != "")


def strip_fences(reply: Column) -> Column:
    """A model's reply without its code fences."""
    return stripped(F.regexp_replace(stripped(reply), r"^```(?:json)?|```\z", ""))


def problem_class(reply: Column, classes: tuple[str, ...] = ("algebra", "calculus", "chemistry", "geometry", "statistics")) -> Column:
    out = F.lit("unknown")
    for name in reversed(classes):
        out = F.when(F.lower(reply).contains(name), name).otherwise(out)
    return out


def label_of(latex: Column) -> Column:
    """Without dollar signs, if they stand at both ends."""
    return F.when(latex.startswith("$") & latex.endswith("$") & (F.length(latex) > 1), latex.substr(F.lit(2), F.length(latex) - 2)).otherwise(latex)


def image_bytes(data: Column) -> Column:
    """Bytes of base64 text or of a data URI; null if it can't be decoded."""
    return F.try_to_binary(F.when(data.contains(","), F.regexp_replace(data, r"(?s)^[^,]*,", "")).otherwise(data), F.lit("base64"))


def postprocess(text: Column, math: bool = False, markup: bool = False) -> Column:
    """struct(text, artifacts_removed, latex_cleaned, math_normalized): the cleaning steps of one line, in order."""
    clean = remove_artifacts(text)
    bare = strip_markup(clean) if markup and not math else clean
    done = normalize_math(bare) if math else bare
    return F.struct(done.alias("text"), (clean != text).alias("artifacts_removed"), (bare != clean).alias("latex_cleaned"), F.lit(math).alias("math_normalized"))


def checked(text: Column, vocabulary: Column | None = None, reject: bool = False) -> Column:
    """struct(original, corrected, plausible, confidence): typos fixed; an implausible text becomes empty if such are rejected."""
    judged = plausibility(text, vocabulary)
    fixed = fix_typos(text)
    return F.struct(text.alias("original"), (F.when(judged["plausible"], fixed).otherwise("") if reject else fixed).alias("corrected"), judged["plausible"].alias("plausible"), judged["confidence"].alias("confidence"))
