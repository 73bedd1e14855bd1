"""Column functions over text, paths and names (T1 to T7, T9, T11, T14, T18 to T24, T29 to T31, F7, F15, F17 to F22, F24, J16, O9). No Python UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end-of-text marker and the separator of packed files; fixed values.
EOT = "<|endoftext|>"
SEPARATOR = f"\n{EOT}\n"
#: White space at the edges as Unicode and the control separators have it.
EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def py_strip(x: Column) -> Column:
    """Both ends without Unicode white space."""
    return F.regexp_replace(x, EDGE, "")


def occurrences(x: Column, literal: str) -> Column:
    """How often a literal stands in a text, without overlap."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def replace_eot(x: Column) -> Column:
    """The marker gives way to a newline."""
    return F.replace(x, F.lit(EOT), F.lit("\n"))


def split_literal(x: Column, literal: str) -> Column:
    """T4: parts between literal separators, empty ones included."""
    return F.split(x, re.escape(literal), -1)


def words(x: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def sha16(x: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(x, 256), 1, 16)


def basename(path: Column) -> Column:
    """T9"""
    return F.element_at(F.split(path, "/"), -1)


def truncated(x: Column) -> Column:
    """The whole part of a product of doubles."""
    return x.cast("double").cast("long")


def domain_of_path(path: Column, fallback: Column | None = None) -> Column:
    """the first path segment that starts with data_, else a fallback, else 'other'."""
    found = F.regexp_extract(F.translate(path, "\\", "/"), r"(?:^|/)(data_[^/]*)", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(fallback, F.lit("")) if fallback is not None else F.lit(None), F.lit("other"))


def parent_dir(path: Column) -> Column:
    """the name of the folder that holds the file, '' if there is none."""
    parts = F.split(path, "/")
    return F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))


def shard_index(name: Column) -> Column:
    """the number between a name's six first and four last characters, -1 where there is none of 64 bits."""
    return F.coalesce(F.regexp_extract(name, r"(?s)^.{6}([+-]?\d+).{4}$", 1).try_cast("long"), F.lit(-1).cast("long"))


def shard_name(index: Column) -> Column:
    """F20"""
    return F.format_string("shard_%05d.bin", index)


def merged_source(first_source: Column, index: Column) -> Column:
    """<folder of the first source>/_merged_<index>."""
    folder = F.regexp_extract(first_source, r"^(.*)/[^/]*$", 1)
    return F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.format_string("_merged_%05d", index))


def language_tag(language: Column) -> Column:
    """c++ becomes cpp."""
    return F.replace(language, F.lit("+"), F.lit("p"))


def padded_vocab(size: Column, multiple: int = 64) -> Column:
    """F24"""
    return (F.ceil(size / multiple) * multiple).cast("long")


def contains_any(query: str, *columns: str) -> Column:
    """case-insensitive substring in any of the columns."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(query.lower()), F.lit(False))
    return found


def seeded_order(seed: int | str, *key: str | Column) -> Column:
    """A seeded, partition-independent shuffle order."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]), 256)


def chat(prompt: Column, response: Column) -> Column:
    """a prompt and a response with speaker markers."""
    return F.concat(F.lit("<|im_start|>user\n"), prompt, F.lit("<|im_end|>\n<|im_start|>assistant\n"), response, F.lit("<|im_end|>"))


def sft_prompt(instruction: Column, given: Column) -> Column:
    """The instruction, and the input where there is one."""
    body = F.when(given != "", F.concat(instruction, F.lit("\n\n"), given)).otherwise(instruction)
    return F.concat(F.lit("<|im_start|>user\n"), body, F.lit("\n<|im_end|>\n<|im_start|>assistant"))


def sft_response(output: Column) -> Column:
    """The response with its end markers."""
    return F.concat(F.lit("\n"), output, F.lit("<|im_end|>" + EOT))


# --- worked arithmetic texts (T18 to T21) ---------------------------------------------

#: Ways of writing an operator; fixed values.
SIGNS = {"\\times": "*", "×": "*", "\\div": "/", "÷": "/", "−": "-"}
#: Substrings and patterns that a worked text must not hold; fixed values.
BANNED = ("('+'", "('-'", "('×'", "('*'", "('/'")
DOUBLED = (r"Step \d+: Step \d+:", r"Step \d+: \d+\.")


#: Lines, boxes, fractions and phrasings of worked texts; fixed values.
ANSWER, PROBLEM, BOXED, FRACTION = r"(?m)^Answer:\s*(.+?)\s*$", r"(?m)^Problem:\s*(.+?)$", r"^\\boxed\{(.+)\}\s*$", r"\\frac\{(-?\d+)\}\{(-?\d+)\}"
LEADS, PHRASING = (r"^Compute\s+", r"^>>> solve\(", r"^>>>\s*"), (r"^Solve\s+", r"\s*for x\.?\s*$")


def declared_answer(text: Column) -> Column:
    """What the Answer line says, unboxed, fractions as a/b; null without such a line."""
    found = F.regexp_extract(text, ANSWER, 1)
    inner = F.trim(F.when(found.rlike(BOXED), F.regexp_extract(found, BOXED, 1)).otherwise(found))
    return F.nullif(F.trim(F.regexp_replace(inner, FRACTION, "$1/$2")), F.lit(""))


def problem_line(text: Column) -> Column:
    """T18"""
    return F.nullif(F.trim(F.regexp_extract(text, PROBLEM, 1)), F.lit(""))


def bare_problem(p: Column) -> Column:
    """A problem without its phrasing."""
    for pattern in LEADS:
        p = F.regexp_replace(p, pattern, "")
    p = F.replace(F.replace(p, F.lit("\\("), F.lit("")), F.lit("\\)"), F.lit(""))
    for pattern in PHRASING:
        p = F.regexp_replace(p, pattern, "")
    opens, closes = (F.length(p) - F.length(F.replace(p, F.lit(c), F.lit(""))) for c in "()")
    p = F.when(opens < closes, F.rtrim(p, F.lit(")"))).otherwise(p)
    return F.trim(F.rtrim(p, F.lit(".")))


def text_gate(text: Column) -> Column:
    """True where no banned substring and no doubled step stands."""
    ok = F.lit(True)
    for b in BANNED:
        ok = ok & ~text.contains(b)
    for d in DOUBLED:
        ok = ok & ~text.rlike(d)
    return ok


def without_rest(a: Column, b: Column) -> Column:
    """a / b of whole decimals where nothing is left over; a quotient alone keeps but 32 digits.

    The upper half of a is divided first, what it leaves goes before the lower half.
    """
    number = lambda x: x.cast("decimal(38,0)")
    less = lambda x: F.try_subtract(number(F.lit(0)), x)  # noqa: E731  (abs and minus round to 34 digits)
    half, m, d = number(F.lit("1" + "0" * 19)), F.when(a < 0, less(a)).otherwise(a), F.when(b < 0, less(b)).otherwise(b)
    low = F.try_mod(m, half)
    high = number(F.try_divide(F.try_subtract(m, low), half))
    left = F.try_mod(high, d)
    upper = F.try_multiply(number(F.try_divide(F.try_subtract(high, left), d)), half)
    lower = number(F.try_divide(F.try_add(F.try_multiply(left, half), low), d))
    q = F.when(d < half, F.try_add(upper, lower)).otherwise(number(F.try_divide(m, d)))
    return F.when((a < 0) != (b < 0), less(q)).otherwise(q)


def evaluated(problem: Column) -> Column:
    """The value of 'a op b', or null; division is floored and names its remainder.

    Operands and values may have 38 digits, all that a Spark number holds; beyond that it is null.
    """
    for sign, plain in SIGNS.items():
        problem = F.replace(problem, F.lit(sign), F.lit(plain))
    a, op, b = (F.regexp_extract(problem, r"^(-?\d+)\s*([+\-*/])\s*(-?\d+)$", k) for k in (1, 2, 3))
    a, b = a.try_cast("decimal(38,0)"), b.try_cast("decimal(38,0)")
    text = lambda x: x.cast("decimal(38,0)").cast("string")
    cut = F.try_mod(a, b)
    r = cut + F.when((cut != 0) & (F.signum(cut) != F.signum(b)), b).otherwise(0)
    q = without_rest(F.try_subtract(a, r), b)
    return (
        F.when(op == "+", text(F.try_add(a, b)))
        .when(op == "-", text(F.try_subtract(a, b)))
        .when(op == "*", text(F.try_multiply(a, b)))
        .when(op == "/", F.when(r == 0, text(q)).otherwise(F.concat(text(q), F.lit(" remainder "), text(r))))
    )


def fenced_json(text: Column) -> Column:
    """JSON without a code fence around it."""
    whole = py_strip(text)
    return F.when(whole.startswith("```"), F.regexp_replace(F.split(whole, "```")[1], "^json", "")).otherwise(whole)


def judge_scores(text: Column, *criteria: str) -> Column:
    """The scores of a judge's answer; those outside 1 to 5 or missing are null."""
    parsed = F.from_json(fenced_json(text), ", ".join(f"{c} INT" for c in criteria))
    return F.struct(*[F.when(parsed[c].between(1, 5), parsed[c]).alias(c) for c in criteria])


def megabytes(size: Column) -> Column:
    """T30"""
    return F.concat(F.format_number(size / 1e6, 1), F.lit(" MB"))


def gigabytes(size: Column) -> Column:
    """T30"""
    return F.concat(F.format_number(size / 1e9, 2), F.lit(" GB"))


def severity(ratio: Column) -> Column:
    """How far a maximum stands out."""
    return F.when(ratio > 20, "severe").when(ratio > 10, "mild").otherwise("ok")


def gap_label(gap: Column) -> Column:
    """How well groups of vectors separate."""
    return F.when(gap > 0.15, "good").when(gap > 0.05, "emerging").when(gap > 0, "weak").otherwise("none")


def learning_rate(step: Column, total: Column, peak: float, least: float, warmup: int) -> Column:
    """Linear warm-up, then a cosine down to the floor."""
    share = F.least(F.lit(1.0), (step - warmup) / F.greatest(F.lit(1), total - warmup))
    return F.when(step < warmup, F.lit(peak) * step / warmup).otherwise(F.lit(least) + 0.5 * (1 + F.cos(F.lit(3.141592653589793) * share)) * (peak - least))


def iso(ts: Column) -> Column:
    """A timestamp as text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def json_line(*columns: str) -> Column:
    """Columns as a JSON object; characters beyond ASCII stay as they are."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def paired(a: Column, b: Column) -> Column:
    """Two lists by position, as long as the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))
