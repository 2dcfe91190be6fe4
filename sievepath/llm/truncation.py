"""Values that stop before their text was complete.

One pass of a stack automaton over the whole value keeps what is open: code fences, inline code,
comments, tags, link targets, brackets, quotes, emphasis. Inside code and comments other marks are
inert. At the end of the value the automaton decides first: a fence, comment or tag left open, or a
bracket, quote, link or emphasis opened in the last line and never closed, is a cut, with or without
a terminator; so is a broken character, an escape that has begun, and a mark that something was left
out. A line that ends exactly where its own first bracket closes is complete.

What is closed but lacks a terminator is weighed against baselines counted over all values:

* by source and form of line, how often lines that cannot have been cut (all but the last of a value)
  end bare. Where that is the habit (list items, headings, a source that never writes full stops) a
  missing terminator says nothing; where it is not (prose, quotations) it is a cut;
* labels, signatures, dates and notes have few inner lines; their openers, and short closing lines
  as a whole, count as the corpus's own endings if enough distinct texts end with them, and they are
  not the beginnings of longer endings nor usually terminated elsewhere;
* a length at which a source's field piles up bare endings far above the lengths around it is a
  limit (of characters or bytes), and a bare ending there is a cut whatever its form.

All three are tables that are joined, so nothing is capped and the driver holds none of them.

Defined cases: null, empty and blank values are never cut off; a missing ``source`` is a source
of its own (null); very long values are read whole; repeated rows are judged row by row, but count
once in the baselines.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Scratch

FIELDS = ("content", "excerpt")
HABIT = 0.5  # share of bare inner lines from which a bare last line of that form is normal
OFTEN = 2e-4  # share of the distinct values that must end alike for an ending of the corpus's own
LEAST = 3  # and at least so many
PRIOR = 20.0  # inner lines that a source borrows from all sources

_END = frozenset("。！？.!?；;:：⋯؟।")
_CLOSERS = "\"'”’」』）)】]》〉*_~`>"
_DECOR = re.compile(r"(?:\s*(?::-?\)|:-?D|;-?\)|\^_\^|:P|[\U0001F300-\U0001FAFF☀-➿️❤]))+$")
# The phrases by which feeds and pages mark that they left something out.
_LEFT_OUT = re.compile(
    r"(?P<dots>\s*(?:…+|\.{3,}|。{3,}|⋯+))?\s*"
    r"(?P<mark>[\[(（【<]?\s*(?:阅读全文|展开全文|展开阅读|展开|显示全部|查看全文|查看更多|查看全部|全文|更多|未完|read more|show more|see more|continue reading|continued|more|truncated|\+\s?\d+\s?(?:chars?|characters|words|字))\s*[\])）】>]?(?:\s*[»›>→]+)?)$",
    re.I,
)
_DOTS = re.compile(r"(?:…+|\.{3,}|⋯+)$")
_TOKEN = re.compile(r"```|`|\*\*|<!--|-->|</?[A-Za-z][^<>]*>|\]\(|[“”「」『』《》（）()\[\]【】]|\n")
_PAIR = {"“": "”", "「": "」", "『": "』", "《": "》", "（": "）", "(": ")", "[": "]", "【": "】", "](": ")"}
_SHUT = {"”": "“", "」": "「", "』": "『", "》": "《", "）": "（", ")": "(", "]": "[", "】": "【"}
_VOID = frozenset(("br", "hr", "img", "input", "meta", "link", "wbr", "p", "li"))
_TAG_NAME = re.compile(r"</?([A-Za-z][\w-]*)")
_HALF_TAG = re.compile(r"""<(?:/?[A-Za-z][\w:-]*(?:\s+[\w:@-]+(?:\s*=\s*(?:"[^"]*"?|'[^']*'?|[^\s"'<>]*))?)*\s*/?|[/!]-?)?$""")
_HALF_ESCAPE = re.compile(r"&(?:#x?[0-9A-Fa-f]{0,6}|[A-Za-z]{0,8})$|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?$")
# Names of character references that may have been begun.
_REFERENCES = ("amp", "lt", "gt", "quot", "apos", "nbsp", "hellip", "mdash", "ndash", "ldquo", "rdquo", "lsquo", "rsquo", "middot", "bull", "copy", "times")
_URL = re.compile(r"(?:^|.*[\s：:（(。！？])(?:https?://|www\.)[\w.-]+\.[a-z]{2,}(?::\d+)?(?:/[^\s]*)?$", re.I)
_ITEM = re.compile(r"(?:[-*+•·](?=\s)|\d{1,3}[.)、）]|[(（]\d{1,3}[)）]|[①-⑳])\s*(?=\S)")
_DATE = re.compile(r"(?:\d{4}\s*年\s*\d{1,2}\s*月(?:\s*\d{1,2}\s*日)?|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})(?=\D|$)")
_LABEL = re.compile(r"([^\W\d_](?:[^\W_]| (?=[^\W_])){0,13})\s?[:：]\s*(?=\S)")
# Closing remarks, and labels that open a last line, in most corpora.
_CLOSINGS = frozenset(("以上", "完", "完结", "全文完", "谢谢", "感谢阅读", "待续", "未完待续", "end", "the end", "fin", "thanks", "thank you", "to be continued"))
_LABELS = frozenset(("标签", "tags", "来源", "source", "原文", "链接", "link", "ps", "注", "note"))


class Automaton:
    """The structural state of one value after its last character."""

    __slots__ = ("stack", "line", "first_closed", "text")

    def __init__(self, text: str):
        self.text = text
        stack: list[tuple[str, int]] = []  # mark, place
        line, closed_at = 0, -1  # where the last line begins; where the bracket that opens it closes
        for m in _TOKEN.finditer(text):
            t, at = m.group(), m.start()
            top = stack[-1][0] if stack else ""
            if t == "\n":
                if top not in ("```", "<!--"):
                    line, closed_at = at + 1, -1
                continue
            if top == "```":
                if t == "```":
                    stack.pop()
            elif top == "<!--":
                if t == "-->":
                    stack.pop()
            elif t == "```":
                stack = [x for x in stack if x[0][0] == "<"] + [(t, at)]
            elif top == "`" and t != "`":
                continue
            elif t in ("`", "**"):
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == t), -1)
                if k >= 0 and (stack[k][1] >= line or t == "**"):
                    del stack[k:]
                else:
                    stack.append((t, at))
            elif t == "<!--":
                stack.append((t, at))
            elif t == "-->":
                continue
            elif t[0] == "<":
                name = _TAG_NAME.match(t)[1].lower()
                if name in _VOID or t[-2] == "/":
                    continue
                if t[1] != "/":
                    stack.append((f"<{name}>", at))
                else:
                    k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == f"<{name}>"), -1)
                    if k >= 0:
                        del stack[k:]
            elif t in ("](",):
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "["), -1)
                if k >= 0 and stack[k][1] >= line:
                    stack[k:] = [(t, stack[k][1])]
                else:
                    stack.append(("(", at + 1))
            elif t in _PAIR:
                if t != "(" or text[at - 1 : at] not in (":", ";", "-"):  # a frown opens nothing
                    stack.append((t, at))
            else:
                k = next((k for k in range(len(stack) - 1, -1, -1) if _PAIR.get(stack[k][0]) == t), -1)
                if k >= 0:
                    if stack[k][1] >= line and not text[line : stack[k][1]].strip():
                        closed_at = m.end()
                    del stack[k:]
        self.stack, self.line = stack, line
        self.first_closed = closed_at

    def open_code(self) -> bool:
        return any(x[0] == "```" for x in self.stack)

    def open_markup(self, finished: bool) -> bool:
        return any(x[0] == "<!--" or x[0] == "](" and x[1] >= self.line or x[0][0] == "<" and not finished for x in self.stack)

    def open_inline(self) -> str | None:
        """The reason, if a mark opened in the last line is still open."""
        for mark, at in self.stack:
            if at >= self.line and mark[0] != "<":
                return "code" if mark == "`" else "markup" if mark in ("**", "](") else "bracket"
        return None


def open_at_end(text: str) -> list[str]:
    """What is still open when the text ends."""
    return [m for m, _ in Automaton(text).stack]


_DECOR_END = frozenset(")DP^️❤")
_MARK_END = frozenset("文开读部多完EeDdSsNn字])）】>»›→")


def _decor(text: str) -> int:
    """Where the smileys at the end begin, or the length of the text."""
    at = len(text)
    while at and (text[at - 1] in _DECOR_END or text[at - 1] > "☀"):
        m = _DECOR.search(text, max(0, at - 8), at)  # one smiley and its blank; the loop takes the next
        if not m:
            break
        at = m.start()
    return at


def _finished(text: str) -> bool:
    """Ends with a terminator, closing marks and smileys aside."""
    t = text[: _decor(text)].rstrip()
    t = t.rstrip(_CLOSERS + " \t\r\n") if t and t[-1] in _CLOSERS else t
    return bool(t) and t[-1] in _END


def _half_escape(t: str) -> bool:
    m = _HALF_ESCAPE.search(t, max(0, len(t) - 10))  # none is longer
    if m:
        word = m.group()[1:]
        return not m.group()[0] == "&" or not word or word[0] == "#" or not t[m.start() - 1 : m.start()].isalpha() and any(r.startswith(word) for r in _REFERENCES)
    word = t[max(t.rfind(" "), t.rfind("\n")) + 1 :]
    return "://" in word and bool(re.search(r"%[0-9A-Fa-f]?$", word))


def line_form(line: str) -> tuple[str, str]:
    """(form, opener) of one stripped line."""
    c = line[0]
    if c == "|":
        return ("table", "") if line[-1] == "|" and len(line) > 1 else ("row", "")
    if c in "#＃":
        words = line.split()
        if all(w[0] in "#＃" and len(w) > 1 and w.strip("#＃") for w in words):
            return "tags", ""
        if c == "#" and re.match(r"#{1,6}\s", line):
            return "heading", ""
    if c == ">":
        return "quote", ""
    if line.startswith(("——", "—", "--", "–", "－－")) and len(line.strip("—-–－ ")) and not line.startswith("---"):
        return ("sign", "dash") if len(line) <= 40 else ("prose", "")
    if c.isdigit():
        if _DATE.match(line) and len(line) <= 30:
            return "date", "date"
    if _ITEM.match(line):
        return "list", ""
    m = re.match(r"\[\^?\w{1,4}\]\s*\S", line)
    if m:
        return "footnote", "footnote"
    m = _LABEL.match(line)
    if m:
        return "label", m[1].lower()
    return "prose", ""


def _last_line(text: str, flat: bool) -> str:
    line = text[text.rfind("\n") + 1 :]
    if flat:  # line ends became blanks: what follows the last finished sentence
        line = line[max((m.end() for m in re.finditer(r"[。！？.!?…」）)]\s+", line)), default=0) :]
    return line.strip()


def _closing(line: str) -> bool:
    return line.rstrip(".…⋯~～ ").lower() in _CLOSINGS


def _siblings(text: str, line: str) -> bool:
    """Whether the list item has one above it, and is of their kind: not much longer than the longest."""
    longest, end = 0, text.rfind("\n")
    while end > 0:
        start = text.rfind("\n", 0, end) + 1
        above = text[start:end].strip()
        if above and not _ITEM.match(above):
            break
        longest, end = max(longest, len(above)), start - 1
    return 0 < longest and len(line) <= 2 * longest + 8


def _tail(t: str) -> int:
    """Where a mark that something was left out may begin: 40 characters hold the longest phrase, before it stand
    digits, dots and blanks of any number."""
    at = max(0, len(t) - 40)
    while at and (t[at - 1] in "….。⋯+" or t[at - 1].isspace() or t[at - 1].isdigit()):
        at -= 1
    return at


def read(text: str, flat: bool = False) -> tuple[str | None, str, str, str, str | None]:
    """(why, state, form, opener, closing line) of one value that is not blank.

    ``why`` is set where the automaton decides; ``state`` is ended, dots, own or bare otherwise. An own
    ending is complete by its structure unless it stands at a limit."""
    t = text.rstrip()
    if t[-1] == "�" or "�" in t[-4:] or "\ud800" <= t[-1] <= "\udfff":
        return "character", "cut", "", "", None
    m = _LEFT_OUT.search(t, _tail(t)) if t[-1] in _MARK_END else None
    if m and (m["dots"] or m["mark"][0] in "[(（【<+" or len(m["mark"]) >= 4 and not m["mark"].isascii()):
        base = t[: m.start()].rstrip()
        if base and not m["mark"].startswith("未完"):
            return (None, "ended", "", "", None) if base[-1] in "。！？!?.\"”" else ("marked", "cut", "", "", None)
    automaton = Automaton(t)
    done = _finished(t)
    if automaton.open_code():
        return "code", "cut", "", "", None
    if automaton.open_markup(done) or _HALF_TAG.match(t, t.rfind("<")) and "<" in t:
        return "markup", "cut", "", "", None
    if _half_escape(t):
        return "escape", "cut", "", "", None
    line = _last_line(t, flat)
    if not line:
        line = t[t.rfind("\n") + 1 :].strip()
    key = re.sub(r"\d+", "0", line) if len(line) <= 40 and (flat or "\n" in t) and len(line) < len(t) else None
    dots = _DOTS.search(t, len(t.rstrip(".…⋯"))) if t[-1] in ".…⋯" else None
    if dots:
        base = t[: dots.start()].rstrip()
        if not base or base[-1] in _END or _closing(line) and key:
            return None, "ended", "", "", key
        return ("marked" if dots.group() not in ("……", "⋯⋯") else None), "dots", "", "", key
    inline = automaton.open_inline()
    if inline:
        return inline, "cut", "", "", None
    if done or t.endswith("```"):
        return None, "ended", "", "", None
    form, opener = line_form(line)
    if automaton.first_closed == len(t) or key and _closing(line) or form in ("table", "tags") or _URL.match(line) or _decor(t) < len(t) or flat and line[0] in _PAIR and line[-1] == _PAIR[line[0]]:
        return None, "own", form, opener, key
    if form == "list" and not flat and not _siblings(t, line):
        form = "prose"
    return None, "bare", form, opener, key


_VALUE = "what string, row_id bigint, source string, field string, text bigint, chars bigint, bytes bigint, why string, state string, form string, opener string, line string, n bigint, bare bigint"
_TYPES = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
_NAMES = [x.split()[0] for x in _VALUE.split(", ")]


def _survey(batches):
    """A row of every value, and counts of inner lines by source, form and opener."""
    for batch in batches:
        out, inner = [], {}
        cols = [batch.column(c).to_pylist() for c in ("row_id", "source", "content", "excerpt")]
        for i, s, content, excerpt in zip(*cols):
            for field, text in (("content", content), ("excerpt", excerpt)):
                if not text or not text.strip():
                    continue
                why, state, form, opener, line = read(text, "\n" not in text)
                if field == "excerpt" and state in ("own", "bare") and content and _inside(text, content):
                    why, state = "sentence", "cut"
                raw = text.encode("utf-8", "surrogatepass")
                bare = state in ("bare", "own", "dots") or why in ("marked", "bracket", "character", "code", "markup", "escape", "sentence")
                out.append(("v", i, s, field, xxhash.xxh3_64_intdigest(raw) - (1 << 63), len(text), len(raw) if bare else None, why, state, form, opener, line, 1, int(bare)))
            if content and "\n" in content:
                rows = content.split("\n")
                code = False
                for row in rows[:-1]:
                    row = row.strip()
                    if row.startswith("```"):
                        code = not code
                    elif row and not code:
                        form, opener = line_form(row)
                        n = inner.setdefault((s, form, opener), [0, 0])
                        n[0] += 1
                        n[1] += not _finished(row)
        out += [("i", None, s, None, None, None, None, None, None, f, o, None, n, b) for (s, f, o), (n, b) in inner.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * len(_TYPES), _TYPES)], names=_NAMES)


def _inside(excerpt: str, content: str) -> bool:
    """The excerpt begins its own content and stops inside a line of it."""
    t = excerpt.rstrip()
    if len(content) <= len(t) or content[len(t)].isspace():
        return False
    return re.sub(r"\s", " ", content[: len(t)]) == re.sub(r"\s", " ", t)


def limits(values: DataFrame) -> DataFrame:
    """(source, field, unit, length) at which bare endings pile up: at least LEAST and a hundredth of all bare
    endings of the field, half of all values of that length, and six deviations over the lengths around."""
    cols = ["source", "field"]
    by = values.groupBy(*cols, F.lit("c").alias("unit"), F.col("chars").alias("length")).agg(F.count("*").alias("n"), F.sum("bare").alias("bare"))
    by = by.unionByName(values.where("bytes is not null").groupBy(*cols, F.lit("b").alias("unit"), F.col("bytes").alias("length")).agg(F.count("*").alias("n"), F.sum("bare").alias("bare")))
    by = by.where("bare > 0")
    near = F.explode(F.sequence(F.col("length") - 8, F.col("length") + 8))
    around = by.select(*cols, "unit", F.col("length").alias("at"), "bare", near.alias("length")).where("at <> length").groupBy(*cols, "unit", "length").agg((F.sum("bare") / 16).alias("around"))
    whole = by.groupBy(*cols, "unit").agg(F.sum("bare").alias("all_bare"))
    same = lambda a, b, names: [a[c].eqNullSafe(b[c]) for c in names]
    x = by.alias("x").join(around.alias("a"), [F.col(f"x.{c}").eqNullSafe(F.col(f"a.{c}")) for c in (*cols, "unit", "length")], "left").select("x.*", F.coalesce("around", F.lit(0.0)).alias("around"))
    x = x.alias("x").join(whole.alias("w"), [F.col(f"x.{c}").eqNullSafe(F.col(f"w.{c}")) for c in (*cols, "unit")]).select("x.*", "all_bare")
    pile = (F.col("bare") >= LEAST) & (F.col("bare") >= 0.01 * F.col("all_bare")) & (F.col("bare") >= 0.5 * F.col("n")) & (F.col("length") >= F.when(F.col("unit") == "c", 50).otherwise(150)) & (F.col("bare") > F.col("around") + 6 * F.sqrt(F.col("around") + 1))
    return x.where(pile).select(*cols, "unit", "length")


def habits(lines: DataFrame) -> DataFrame:
    """(source, form, habit): the share of bare inner lines, drawn towards that of all sources."""
    by = lines.groupBy("source", "form").agg(F.sum("n").alias("n"), F.sum("bare").alias("bare"))
    pool = by.groupBy("form").agg((F.sum("bare") / F.sum("n")).alias("pool"))
    return by.join(pool, "form").select("source", "form", ((F.col("bare") + PRIOR * F.col("pool")) / (F.col("n") + PRIOR)).alias("habit"))


def endings(values: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The corpus's own openers of last lines and closing lines: (opener) and (line)."""
    last = values.where("state in ('bare', 'dots', 'own')").select("text", "opener", "line").dropDuplicates(["text"])
    enough = values.agg(F.greatest(F.lit(float(LEAST)), OFTEN * F.approx_count_distinct("text")).alias("enough"))
    inner = lines.where("opener <> ''").groupBy("opener").agg(F.sum("n").alias("n_in"), F.sum("bare").alias("bare_in"))
    by = last.where("opener <> ''").groupBy("opener").agg(F.count("*").alias("n")).join(inner, "opener", "left").join(F.broadcast(enough))
    openers = by.where("n >= enough and (coalesce(n_in, 0) < n or bare_in >= n_in * 0.5)").select("opener")
    ends = last.where("line is not null").groupBy("line").agg(F.count("*").alias("n"))
    heads = ends.select(F.explode(F.expr("transform(sequence(1, greatest(length(line) - 1, 1)), k -> substring(line, 1, k))")).alias("line"), F.col("line").alias("longer"), "n").where("line <> longer")
    # only beginnings that are endings themselves matter, so the long list shrinks before it is counted
    often = ends.join(F.broadcast(enough)).where("n >= enough").select("line", "n")
    begun = heads.join(often.select("line"), "line", "left_semi").groupBy("line").agg(F.sum("n").alias("longer"))
    closings = often.join(begun, "line", "left").where("coalesce(longer, 0) * 10 <= n").select("line")
    return openers, closings


def judged(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows``: (row_id, source, content, excerpt). Returns (row_id, source, field, why) of every value that is
    not blank; ``why`` is null where the value is complete."""
    store = Scratch(spark, "truncation")
    shaped = rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("source").cast("string").alias("source"), F.col("content").cast("string").alias("content"), F.col("excerpt").cast("string").alias("excerpt"))
    seen = store.write(shaped.mapInArrow(_survey, _VALUE), "seen", by="what")
    values, lines = seen.where("what = 'v'").drop("what"), seen.where("what = 'i'").drop("what")
    found = store.write(limits(values.dropDuplicates(["source", "field", "text"])), "limits")
    habit = store.write(habits(lines), "habits")
    openers, closings = (store.write(x, n) for x, n in zip(endings(values, lines), ("openers", "closings")))
    v = values.alias("v")
    for unit, length in (("c", "chars"), ("b", "bytes")):
        pile = found.where(F.col("unit") == unit).select("source", "field", "length", F.lit(True).alias("hit")).alias(unit)
        v = v.join(pile, F.col("v.source").eqNullSafe(F.col(f"{unit}.source")) & (F.col("v.field") == F.col(f"{unit}.field")) & (F.col(f"v.{length}") == F.col(f"{unit}.length")), "left")
    v = v.join(habit.alias("h"), F.col("v.source").eqNullSafe(F.col("h.source")) & (F.col("v.form") == F.col("h.form")), "left")
    v = v.join(openers.select(F.col("opener").alias("own_opener")), F.col("v.opener") == F.col("own_opener"), "left").join(closings.select(F.col("line").alias("own_line")), F.col("v.line") == F.col("own_line"), "left")
    at_limit = F.col("c.hit").isNotNull() | F.col("b.hit").isNotNull()
    own = F.col("own_line").isNotNull() | F.col("own_opener").isNotNull() | F.col("v.opener").isin(*sorted(_LABELS))
    usual = F.coalesce(F.col("h.habit") >= HABIT, F.lit(False)) & (F.col("v.opener") == "")
    why = (
        F.when(F.col("v.state") == "cut", F.col("v.why"))
        .when(F.col("v.state") == "ended", None)
        .when(F.col("v.state") == "dots", F.when(F.col("own_line").isNotNull(), None).when(F.col("v.why").isNotNull() | at_limit, "marked"))
        .when(at_limit, "limit")
        .when(F.col("v.state") == "own", None)
        .when(own | usual, None)
        .otherwise("sentence")
    )
    return store.write(v.select("v.row_id", "v.source", "v.field", why.alias("why")), "judged")


def judge(text: str | None, flat: bool = False, usual: frozenset = frozenset({"list", "heading", "footnote", "sign", "date"})) -> str | None:
    """The verdict on one value without any corpus: forms in ``usual`` may end bare."""
    if text is None or not text.strip():
        return None
    why, state, form, opener, _ = read(text, flat)
    if state in ("cut", "dots"):
        return why
    return None if state in ("ended", "own") or form in usual or opener in _LABELS else "sentence"


def rates(values: DataFrame) -> DataFrame:
    """The share of cut-off values by source and field."""
    cut = F.count_if(F.col("why").isNotNull())
    return values.groupBy("source", "field").agg(F.count("*").alias("n_values"), cut.alias("n_cut"), F.round(cut / F.count("*"), 6).alias("cut_share"))
