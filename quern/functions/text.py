"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.strip`` and ``\\s`` see it.
_WS = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Removes white space of any kind at both ends."""
    return F.regexp_replace(_c(x), rf"^{_WS}+|{_WS}+$", "")


def collapse_spaces(x: Column | str) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(_c(x), rf"{_WS}+", " "))


def normalize_answer(x: Column | str) -> Column:
    """Answers that differ only in dollar signs, spaces or case are equal."""
    return strip(F.lower(F.translate(_c(x), "$ ", "")))


def last_boxed(x: Column | str, opening: str = "\\boxed{") -> Column:
    """The content of the last box by balance of braces; null without a box, or where the last one isn't closed."""
    text = _c(x)
    parts = F.split(text, r"\\boxed\{" if opening == "\\boxed{" else "\\Q" + opening + "\\E")
    tail = F.element_at(parts, -1)
    # Depth after each character; the box ends where the depth first drops below zero.
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("end"))

    def step(s: Column, ch: Column) -> Column:
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (s["at"] + 1).alias("at"), F.when((s["end"] < 0) & (depth < 0), s["at"]).otherwise(s["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step)["end"]
    return F.when((F.size(parts) > 1) & (end >= 0), F.substring(tail, F.lit(1), end))


def final_answer(x: Column | str) -> Column:
    """The boxed answer, else the whole text."""
    return F.coalesce(last_boxed(x), _c(x))


def clean_solution(x: Column | str, strip_think: bool = True, tag: str = "</think>") -> Column:
    """struct<text, stripped>: what follows the last closing think tag."""
    text = _c(x)
    if not strip_think:
        return F.struct(strip(text).alias("text"), F.lit(False).alias("stripped"))
    return F.struct(strip(F.substring_index(text, tag, -1)).alias("text"), F.contains(text, F.lit(tag)).alias("stripped"))


def dollar_wrap(x: Column | str) -> Column:
    """In dollar signs, unless there is one already."""
    text = strip(x)
    return F.when(F.contains(text, F.lit("$")), text).otherwise(F.concat(F.lit("$"), text, F.lit("$")))


def ensure_boxed(x: Column | str) -> Column:
    text = strip(x)
    return F.when(F.contains(text, F.lit("\\boxed")), text).otherwise(F.concat(F.lit("\\boxed{"), text, F.lit("}")))


def shorten(x: Column | str, most: int = 80) -> Column:
    text = _c(x)
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def last_code_block(x: Column | str, fence: str = "```lean") -> Column:
    """The inside of the last block that ``fence`` opens; the whole text without one."""
    text = _c(x)
    return strip(F.when(F.contains(text, F.lit(fence)), F.substring_index(F.substring_index(text, fence, -1), "```", 1)).otherwise(text))


def _part(v) -> Column:
    """One part of a stable hash: texts in single quotes, numbers as they are, each closed by a zero byte."""
    if isinstance(v, Column):
        return F.concat(F.encode(v, "UTF-8"), F.unhex(F.lit("00")))
    shown = repr(v)
    return F.concat(F.encode(F.lit(shown), "UTF-8"), F.unhex(F.lit("00")))


#: What a quoted text shows as a number: controls, formats and separators other than the space.
_HIDDEN = r"[\p{C}\p{Z}&&[^ ]]"


def quoted(x: Column | str) -> Column:
    """How a text column enters ``stable_hash``: as Python's ``repr`` writes it.

    Double quotes hold it where it has single ones only; backslashes, the quote and hidden characters are escaped.
    """
    text = _c(x)
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    plain = F.when(double, plain).otherwise(F.replace(plain, F.lit("'"), F.lit("\\'")))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        plain = F.replace(plain, F.lit(raw), F.lit(shown))

    def shown_as(c: Column) -> Column:
        number = F.lower(F.hex(F.ascii(c)))
        wide = F.when(F.length(number) <= 2, F.concat(F.lit("\\x"), F.lpad(number, 2, "0"))).when(F.length(number) <= 4, F.concat(F.lit("\\u"), F.lpad(number, 4, "0")))
        return F.when(c.rlike(_HIDDEN), wide.otherwise(F.concat(F.lit("\\U"), F.lpad(number, 8, "0")))).otherwise(c)

    hidden = F.array_join(F.transform(F.split(plain, ""), shown_as), "")
    mark = F.when(double, '"').otherwise("'")
    return F.concat(mark, F.when(plain.rlike(_HIDDEN), hidden).otherwise(plain), mark)


def stable_hash(*parts) -> Column:
    """First 16 hex digits of SHA-256 over the parts. Number columns are given as ``col.cast('string')``, texts by ``quoted``."""
    return F.left(F.sha2(F.concat(*[_part(p) for p in parts]), 256), F.lit(16))


def stable_seed(*parts) -> Column:
    """A 31-bit seed from the first eight digits of the hash."""
    return F.conv(F.left(stable_hash(*parts), F.lit(8)), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))


def question_id(prefix: str, x: Column | str) -> Column:
    """An id derived from text."""
    return F.concat(F.lit(prefix), stable_hash(quoted(x)))


def namespaced(qid: Column | str, space: str = "bench-") -> Column:
    q = _c(qid)
    return F.when(q.startswith(space), q).otherwise(F.concat(F.lit(space), q))


def candidate_key(qid: Column | str, base: Column | str, attempt: Column | str) -> Column:
    return F.concat_ws(":", _c(qid).cast("string"), _c(base).cast("string"), _c(attempt).cast("string"))


def format_alpha(alpha: Column | str) -> Column:
    """The shortest plain form: 1, 0.5, 0.05."""
    return F.regexp_replace(F.format_string("%.6f", _c(alpha)), r"\.?0+$", "")


def render_turns(turn: Column | str, role: Column | str, text: Column | str, opening: str = "<|im_start|>", closing: str = "<|im_end|>\n") -> Column:
    """Aggregate: a conversation's turns in order as one prompt."""
    each = F.struct(_c(turn).alias("turn"), F.concat(F.lit(opening), _c(role), F.lit("\n"), _c(text), F.lit(closing)).alias("said"))
    return F.array_join(F.transform(F.sort_array(F.collect_list(each)), lambda t: t["said"]), "")


def render_question(question: Column | str, template: str, **values: Column) -> Column:
    """``template`` with {question} and further {names} replaced by columns."""
    out: list[Column] = []
    rest, names = template, {"question": _c(question), **values}
    while rest:
        at = min(((rest.find("{" + n + "}"), n) for n in names if "{" + n + "}" in rest), default=None)
        if at is None:
            out.append(F.lit(rest))
            break
        if at[0]:
            out.append(F.lit(rest[: at[0]]))
        out.append(names[at[1]])
        rest = rest[at[0] + len(at[1]) + 2 :]
    return F.concat(*out)
