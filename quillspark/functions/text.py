"""Column functions over text: cleaning, Markdown stripping, keyword validity, time stamps, tables, page specs.

White space means Unicode white space plus U+001C to U+001F, as in the semantics these functions follow; Java's plain \\s is ASCII.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1C-\x1F]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
# Stop words, and punctuation left out of character n-grams.
STOP_WORDS = (
    "我们 你们 他们 这个 那个 可以 就是 什么 这样 那样 所以 但是 因为 "
    "如果 而且 并且 以及 然后 现在 这里 里面 一个 一些 非常 重要 时候 "
    "需要 进行 使用 因此 或者 不是 没有 这些 那些 可能 已经 就是 那么 "
    "接下来 下面 上面 上面 其中 这种 各种 同时 由于 关于 对于 通过 经过 "
    "根据 按照 作为 出现 发生 存在 成为 具有 属于 包括 包含 比如 例如 "
    "另外 此外 尤其 特别 十分 比较 几乎 大约 也许 当然 显然 其实 实际上 "
    "总之 最后 首先 其次 这样 那样 是不是 有没有 会觉得 来看 看一下"
).split()
GRAM_PUNCTUATION = "，。！？、；：\"'（）【】《》·—… \t\r\n#>*|_-[]()`"
# Spoken fillers, in the order they are removed.
FILLERS = ["嗯+", "啊+", "呃+", "哦+", "好[的吧]?", "那么", "这个这个", "那个那个", "就是说", "就是", "对吧", "你知道吧", "这样一来", "我们来看一下"]


def let(value: Column, f) -> Column:
    """f(value) with value computed once, also where f uses it inside a lambda."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){WS}+\z", "")


def no_space(c: Column) -> Column:
    """P20: all white space removed."""
    return F.regexp_replace(c, rf"(?U){WS}+", "")


def squeeze(c: Column) -> Column:
    """An anchor's form, runs of white space made one blank."""
    return strip(F.regexp_replace(c, rf"(?U){WS}+", " "))


def clean_inline(c: Column) -> Column:
    """Zero-width characters go, no-break blanks become blanks, runs of blanks shrink; no compatibility folding."""
    return strip(F.regexp_replace(F.translate(c, " ​﻿", " "), "[ \t]{2,}", " "))


def strip_md(c: Column) -> Column:
    """P5: front matter, comments, formulas, code, links, images and heading marks removed, in this order."""
    shut = F.locate("\n---", c, 4)
    c = F.when(c.startswith("---") & (shut > 0), F.substr(c, shut + 4)).otherwise(c)
    for pattern, by in (
        (r"(?s)<!--.*?-->", " "),
        (r"(?s)\$\$.*?\$\$", " "),
        (r"\$[^$\n]*\$", " "),
        (r"(?s)```.*?```|`[^`]*`|!?\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)", " "),
        (rf"(?mU)^{WS}{{0,3}}#{{1,6}}{WS}*", ""),
    ):
        c = F.regexp_replace(c, pattern, by)
    return c


_PLAIN = [(re.compile(p, re.S), by) for p, by in ((r"<!--.*?-->", " "), (r"\$\$.*?\$\$", " "), (r"\$[^$\n]*\$", " "), (r"```.*?```|`[^`]*`|!?\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)", " "))]
_MARKS, _ODD_END = re.compile(r"^\s{0,3}#{1,6}\s*", re.M), re.compile("[\r\x85\u2028\u2029]")
_MARKS_ODD = re.compile(r"(?:\A|(?<=[\n\x85\u2028\u2029])|(?<=\r)(?!\n))\s{0,3}#{1,6}\s*")


def plain_md(t: str) -> str:
    """P5 in Python, for operators that hold a text there anyway: what strip_md gives."""
    if t.startswith("---") and (shut := t.find("\n---", 3)) >= 0:
        t = t[shut + 4 :]
    for pattern, by in _PLAIN:
        t = pattern.sub(by, t)
    return (_MARKS_ODD if _ODD_END.search(t) else _MARKS).sub("", t)


def valid_keyword(c: Column) -> Column:
    """Two characters or more, no number, page, short Latin word, video size, metadata or stop word."""
    noise = c.rlike(r"(?U)\A[\d\s.、%\-]+\z") | c.rlike(r"\A[A-Za-z]{1,2}\z") | c.rlike(r"(?U)\A\d{2,4}[PpKk]\z") | c.rlike(r"(?i)\A(cc|bilibili|subtitle|clippings)\z")
    return (F.char_length(c) >= 2) & ~noise & ~c.isin(*sorted(set(STOP_WORDS)))


def gram_text(c: Column) -> Column:
    return F.translate(c, GRAM_PUNCTUATION, "")


def shingles(c: Column, n: int = 4) -> Column:
    """The distinct n-grams of the text without punctuation; a shorter text is its own; empty text has none.

    The text is cut into characters once: looking up the i-th character of a string would walk from its start every time.
    """
    def cut(x):
        gram = lambda i: F.concat(*[F.get(x, i + j) for j in range(n)])
        return F.when(F.size(x) < n, F.array(F.array_join(x, ""))).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - n, F.lit(0))), gram)))

    t = gram_text(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(let(F.split(t, ""), cut))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets, 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def parse_ts(c: Column) -> Column:
    """h:m:s, m:s or s to seconds, comma or point decimals; -1 where that fails."""
    p = F.split(strip(F.replace(c, F.lit(","), F.lit("."))), ":")
    num = F.transform(p, lambda x: F.expr("1").cast("double") * 0 + x.try_cast("double"))
    bad = F.exists(num, lambda x: x.isNull())
    n = F.size(num)
    sec = F.when(n == 3, num[0] * 3600 + F.get(num, F.lit(1)) * 60 + F.get(num, F.lit(2))).when(n == 2, num[0] * 60 + F.get(num, F.lit(1))).otherwise(num[0])
    return F.when(bad, F.lit(-1.0)).otherwise(sec)


def fmt_ts(c: Column) -> Column:
    """HH:MM:SS, rounded down, at least 0."""
    s = F.greatest(F.lit(0), c.cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def is_cjk(c: Column) -> Column:
    """the first character is U+4E00 to U+9FFF."""
    return c.rlike("^[一-鿿]")


def join_cjk(a: Column, b: Column) -> Column:
    """joined directly if either side of the seam is CJK, else by a blank."""
    close = F.substring(a, -1, 1).rlike("[一-鿿]") | is_cjk(b)
    return F.when(F.char_length(a) == 0, b).when(F.char_length(b) == 0, a).when(close, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def despeak(c: Column) -> Column:
    """Fillers go where punctuation or white space stands on both sides, or at the head before a comma.

    A text without a filler's first character and without commas and stops has nothing to remove; one search tells.
    """
    out = c
    for f in FILLERS:
        out = F.regexp_replace(out, rf"(?U)(?<=[\s\x1C-\x1F，。！？、；：]){f}(?=[\s\x1C-\x1F，。！？、；：])", "")
        out = F.regexp_replace(out, rf"\A{f}(?=[，、])", "")
    out = F.regexp_replace(F.regexp_replace(out, "[，、]{2,}", "，"), r"\A[，、。]+", "")
    return strip(F.when(c.rlike(f"[{''.join(sorted({f[0] for f in FILLERS}))}，、。]"), out).otherwise(c))


def decode_symbols(c: Column, table: dict[int, str]) -> Column:
    """Private-area characters U+F020 to U+F0FF by their symbol-font code; table maps codes to characters."""
    one = {chr(0xF000 + k): v for k, v in table.items() if len(v) == 1}
    c = F.translate(c, "".join(one), "".join(one.values())) if one else c
    for code, value in sorted(table.items()):
        if len(value) != 1:
            c = F.replace(c, F.lit(chr(0xF000 + code)), F.lit(value))
    return c


def looks_like_title(c: Column) -> Column:
    """At most 30 characters and no full stop."""
    return (F.char_length(c) <= 30) & ~F.contains(c, F.lit("。"))


def is_decorative(c: Column) -> Column:
    """Page numbers and the like."""
    return c.rlike(r"(?U)\A[\d\s./-]+\z")


def table_markdown(rows: Column, pad: bool) -> Column:
    """S25 (pad) / S26: rows of cells as a Markdown table: pipes escaped, a separator row, ragged rows padded or not."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda x: F.replace(clean_inline(x), F.lit("|"), F.lit("\\|"))
    cells = lambda r: F.transform(r, cell)
    wide = (lambda r: F.concat(cells(r), F.array_repeat(F.lit(""), width - F.size(r)))) if pad else cells
    line = lambda r: F.concat(F.lit("| "), F.array_join(wide(r), " | "), F.lit(" |"))
    first = F.size(F.element_at(rows, 1)) if not pad else width
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), first), " | "), F.lit(" |"))
    made = F.transform(rows, line)
    return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.array_join(F.concat(F.slice(made, 1, 1), F.array(rule), F.slice(made, 2, F.size(rows))), "\n"))


def page_spec(spec: Column, total: Column) -> Column:
    """Pages of "1,5,7-9" or "[4, 26]": reversed ranges swapped, in order, once, within 1 to total."""
    parts = F.filter(F.transform(F.split(F.translate(spec, "[]", ""), ","), strip), lambda p: p != "")
    return F.filter(F.array_distinct(F.flatten(F.transform(parts, _range(swap=True)))), lambda p: (p >= 1) & (p <= total))


def page_spec_loose(spec: Column) -> Column:
    """As page_spec, but repeats stay, nothing is bounded, and a reversed range is empty."""
    parts = F.filter(F.transform(F.split(spec, ","), strip), lambda p: p != "")
    return F.flatten(F.transform(parts, _range(swap=False)))


def _range(swap: bool):
    def pages(p):
        a, b = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int"), F.regexp_extract(p, r"-\s*(\d+)$", 1).try_cast("int")
        b = F.coalesce(b, a)
        if swap:
            return F.sequence(F.least(a, b), F.greatest(a, b))
        return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    return pages


def page_label(lo: Column, hi: Column) -> Column:
    """"3" or "3-5"."""
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat(lo.cast("string"), F.lit("-"), hi.cast("string")))


def colour_distance(r, g, b, other: tuple[int, int, int]) -> Column:
    """Manhattan distance of RGB values."""
    return F.abs(r - other[0]) + F.abs(g - other[1]) + F.abs(b - other[2])


def colour(c: Column) -> Column:
    """F16: "r,g,b" to an array of integers."""
    return F.transform(F.split(c, ","), lambda x: strip(x).cast("int"))


def to_points(px: Column, dpi: int) -> Column:
    """pixels to points, one decimal, halves to even."""
    return F.bround(px * 72.0 / dpi, 1)


def insert_lines(lines: Column, at: Column, content: Column) -> Column:
    """content lines put before line `at`, kept apart from their neighbours by an empty line."""
    block = F.split(F.regexp_replace(content, r"\A\n+|\n+\z", ""), LINE_END)
    none, gap = F.array().cast("array<string>"), F.array(F.lit(""))
    before = F.when((at > 0) & (strip(F.get(lines, at - 1)) != ""), gap).otherwise(none)
    after = F.when((at < F.size(lines)) & (strip(F.get(lines, at)) != ""), gap).otherwise(none)
    head = F.when(at > 0, F.slice(lines, F.lit(1), F.greatest(at, F.lit(1)))).otherwise(none)
    return F.concat(head, before, block, after, F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))))


def to_note(lines: Column) -> Column:
    """Lines to a note's text: joined by line feeds, exactly one at the end."""
    return F.concat(F.regexp_replace(F.array_join(lines, "\n"), r"\n+\z", ""), F.lit("\n"))
