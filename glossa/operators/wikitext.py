"""Wikitext to plain text: templates, parser functions, links, markup, sections, infoboxes.

The grammar is recursive, so pages go through an Arrow UDF; templates are a small table that tasks hold. Nothing in a
page is ever evaluated as code, nesting is bounded, and whatever fails yields the empty string.
"""

from __future__ import annotations

import datetime as dt
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType

from ..functions.text import unescape_text

MAX_DEPTH, MAX_PARAMETER_DEPTH = 30, 10
#: Characters of templates that a task may hold.
TEMPLATE_CHARS = 512_000_000
ACCEPTED = {"w", "wiktionary", "wikt"}
DROPPED = ["gallery", "timeline", "noinclude", "pre", "table", "tr", "td", "th", "caption", "div", "form", "input", "select", "option", "textarea", "ul", "li", "ol", "dl", "dt", "dd", "menu", "dir", "ref", "references", "img", "imagemap", "source", "small", "sub", "sup"]
UNWRAPPED = ["abbr", "b", "big", "blockquote", "center", "cite", "div", "em", "font", "h1", "h2", "h3", "h4", "hiero", "i", "kbd", "nowiki", "p", "plaintext", "s", "span", "strike", "strong", "sub", "sup", "tt", "u", "var"]
SINGLE = ["br", "hr", "nobr", "ref", "references", "nowiki"]
NUMBERED = {"math": "formula", "code": "codice"}
MAGIC = ("!", "pagename", "fullpagename", "currentyear", "currentmonth", "currentday", "currenthour", "currenttime")


# --- balanced braces ----------------------------------------------------------------


def spans(text: str, opening: str, closing: str) -> Iterator[tuple[int, int]]:
    """Outermost balanced spans; an unclosed one ends the search."""
    mark = re.compile(f"{re.escape(opening)}|{re.escape(closing)}")
    depth, start = 0, 0
    for m in mark.finditer(text):
        if m[0] == opening:
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                yield start, m.end()


def drop_nested(text: str, opening: str, closing: str) -> str:
    """Without what stands between the marks, nested or not; unbalanced text loses everything from the first span to the last close."""
    events = [(m.start(), m.end(), bool(re.fullmatch(opening, m[0]))) for m in re.finditer(f"{opening}|{closing}", text)]
    depth, start, cut, first, last = 0, 0, [], None, None
    for a, b, opens in events:
        if opens:
            start, first = (a if depth == 0 else start), a if first is None else first
            depth += 1
        elif depth:
            depth -= 1
            last = b
            if depth == 0:
                cut.append((start, b))
    if depth and last is not None:
        cut = [(first, last)]
    return drop_spans(text, cut)


def drop_spans(text: str, cut: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in sorted(cut):
        if a >= at:
            out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]])


def braces(text: str) -> Iterator[tuple[int, int, int]]:
    """Outermost {{…}} (2) and {{{…}}} (3): start, end, kind. Runs of braces pair from the inside; three bind before two."""
    stack: list[list] = []
    i, n = 0, len(text)
    found: list[tuple[int, int, int]] = []
    while i < n:
        c = text[i]
        if c == "{":
            j = i
            while j < n and text[j] == "{":
                j += 1
            if j - i >= 2:
                stack.append([i, j - i])
            i = j
        elif c == "[" and text.startswith("[[", i):
            stack.append([i, -2])
            i += 2
        elif c == "]" and text.startswith("]]", i):
            if stack and stack[-1][1] < 0:
                stack.pop()
            i += 2
        elif c == "}":
            j = i
            while j < n and text[j] == "}":
                j += 1
            k = j - i
            while k >= 2 and stack:
                while stack and stack[-1][1] < 0:
                    stack.pop()
                if not stack:
                    break
                at, left = stack[-1]
                take = 3 if min(k, left) >= 3 and not (left == 4 and k == 2) else 2
                k -= take
                end = j - k
                left -= take
                stack.pop()
                if left >= 2:
                    stack.append([at, left])
                if left < 2 and not any(x[1] > 0 for x in stack):
                    begin = at + max(left, 0)
                    found = [f for f in found if f[0] < begin]
                    found.append((begin, end, take))
                elif left >= 2 and not any(x[1] > 0 for x in stack[:-1]):
                    found = [f for f in found if f[0] < at + left]
                    found.append((at + left, end, take))
            i = j
        else:
            i += 1
    yield from found


def split_parts(text: str) -> list[str]:
    """At the pipes outside nested braces and links."""
    parts, depth, at, i = [], 0, 0, 0
    while i < len(text):
        two = text[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = max(0, depth - 1), i + 2
        elif text[i] == "|" and not depth:
            parts.append(text[at:i])
            at = i = i + 1
        else:
            i += 1
    return [*parts, text[at:]]


# --- parser functions ------------------------------------------------------------------


def evaluate(text: str) -> str:
    """Arithmetic, comparison and logic on numbers, by recursive descent."""
    tokens = re.findall(r"\d+\.?\d*(?:e[+-]?\d+)?|\.\d+|<=|>=|<>|!=|[-+*/^()=<>]|[a-z]+", text.lower())
    if "".join(tokens) != re.sub(r"\s+", "", text.lower()):
        raise ValueError("unexpected character")
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    levels: list[dict[str, Callable]] = [
        {"or": lambda a, b: float(bool(a) or bool(b))},
        {"and": lambda a, b: float(bool(a) and bool(b))},
        {"=": lambda a, b: float(a == b), "<>": lambda a, b: float(a != b), "!=": lambda a, b: float(a != b), "<": lambda a, b: float(a < b), ">": lambda a, b: float(a > b), "<=": lambda a, b: float(a <= b), ">=": lambda a, b: float(a >= b)},
        {"round": lambda a, b: float(round(a, int(b)))},
        {"+": operator.add, "-": operator.sub},
        {"*": operator.mul, "/": operator.truediv, "div": operator.truediv, "mod": lambda a, b: float(int(a) % int(b))},
    ]

    def level(k: int) -> float:
        if k == len(levels):
            return power()
        left = level(k + 1)
        while peek() in levels[k]:
            left = levels[k][take()](left, level(k + 1))
        return left

    def power() -> float:
        left = unary()
        while peek() == "^":
            take()
            exponent = unary()
            if abs(exponent) > 1000:
                raise ValueError("too large")
            left = left**exponent
        return left

    def unary() -> float:
        t = peek()
        if t is None:
            raise ValueError("incomplete")
        take()
        if t in ("-", "+", "not"):
            x = unary()
            return -x if t == "-" else x if t == "+" else float(not x)
        if t == "(":
            x = level(0)
            if peek() != ")":
                raise ValueError("unbalanced")
            take()
            return x
        return float(t)

    value = level(0)
    if peek() is not None:
        raise ValueError("trailing text")
    return str(int(value)) if value == int(value) else repr(value)


ERROR = re.compile(r'class\s*=\s*["\'][^"\']*\berror\b', re.I)


def _expr(x: str = "", *_: str) -> str:
    try:
        return evaluate(x) if x.strip() else ""
    except (ValueError, ZeroDivisionError, OverflowError, TypeError) as e:
        return f'<span class="error">{e}</span>'


def _if(test: str = "", then: str = "", other: str = "", *_: str) -> str:
    return (then if test.strip() else other).strip()


def _ifeq(left: str = "", right: str = "", then: str = "", other: str = "", *_: str) -> str:
    return "" if not right.strip() else (then if left.strip() == right.strip() else other).strip()


def _iferror(test: str = "", then: str = "", other: str | None = None, *_: str) -> str:
    return then.strip() if ERROR.search(test) else (test if other is None else other).strip()


def _switch(key: str = "", *cases: str) -> str:
    key, matched, default = key.strip(), False, ""
    for case in cases:
        name, has, value = case.partition("=")
        name = name.strip()
        matched |= name == key
        if has and matched:
            return value.strip()
        if has and name == "#default":
            default = value.strip()
    return default


def first_upper(s: str) -> str:
    return s[:1].upper() + s[1:]


def first_lower(s: str) -> str:
    return s[:1].lower() + s[1:]


NOTHING = ("#ifexpr", "#ifexist", "#rel2abs", "#language", "#time", "#timel", "#titleparts")
FUNCTIONS: dict[str, Callable[..., str]] = {
    "#expr": _expr, "#if": _if, "#ifeq": _ifeq, "#iferror": _iferror, "#switch": _switch,
    "urlencode": lambda s="", *_: quote(s), "lc": lambda s="", *_: s.lower(), "uc": lambda s="", *_: s.upper(),
    "lcfirst": lambda s="", *_: first_lower(s), "ucfirst": lambda s="", *_: first_upper(s), "int": lambda s="", *_: str(int(s)),
    **{n: lambda *_: "" for n in NOTHING},
}
MODULES: dict[str, dict[str, Callable[..., str]]] = {"convert": {"convert": lambda value="", unit="", *_: f"{value} {unit}"}}


# --- templates ----------------------------------------------------------------------------


@dataclass
class Site:
    """Templates by title, redirects between them, and the namespace's prefix."""

    templates: dict[str, str] = field(default_factory=dict)
    redirects: dict[str, str] = field(default_factory=dict)
    prefix: str = "Template:"

    def define(self, title: str, page: str) -> None:
        target = re.match(r"\s*#REDIRECT\S*\s*:?\s*\[\[([^\]|]*)", page, re.I)
        if target:
            self.redirects[title] = target[1].strip()
            return
        text = re.sub(r"<!--.*?-->", "", unescape_text(page), flags=re.S)
        text = re.sub(r"<noinclude>.*?</noinclude>", "", text, flags=re.S)
        text = re.sub(r"<noinclude\s*>.*$|<noinclude\s*/>", "", text, flags=re.S)
        only = "".join(m[1] for m in re.finditer(r"<onlyinclude>(.*?)</onlyinclude>", text, re.S))
        text = only or re.sub(r"</?includeonly>", "", text)
        if text:
            self.templates[title] = text

    def qualified(self, title: str) -> str:
        if title.startswith(":"):
            return first_upper(title[1:])
        space, colon, rest = title.partition(":")
        return f"{first_upper(space)}:{first_upper(rest)}" if colon and rest else self.prefix + first_upper(title)


@dataclass
class Page:
    """One page's expansion. ``now`` is a parameter, so that results repeat."""

    site: Site = field(default_factory=Site)
    title: str = ""
    now: dt.datetime = dt.datetime(2015, 1, 1)
    keep_links: bool = False
    keep_sections: bool = False
    html: bool = False
    #: Parameters whose names or defaults are being read.
    inside: int = field(default=0, init=False)

    def magic(self, name: str) -> str | None:
        n = self.now
        return {"!": "|", "pagename": self.title, "fullpagename": self.title, "currentyear": str(n.year), "currentmonth": f"{n.month:02d}", "currentday": str(n.day), "currenthour": f"{n.hour:02d}", "currenttime": f"{n:%H:%M:%S}"}.get(name.lower())

    def expand(self, text: str, depth: int = 0, params: dict[str, str] | None = None) -> str:
        if depth > MAX_DEPTH:
            return ""
        out, at = [], 0
        for a, b, kind in braces(text):
            out.append(text[at:a])
            if kind == 3:
                out.append(self.parameter(text[a + 3 : b - 3], params, depth + 1))
            else:
                out.append(self.call(text[a + 2 : b - 2], depth + 1, params))
            at = b
        return "".join([*out, text[at:]])

    def parameter(self, body: str, params: dict[str, str] | None, depth: int) -> str:
        if depth > MAX_DEPTH or self.inside >= MAX_PARAMETER_DEPTH:
            return ""
        self.inside += 1
        try:
            name, *rest = split_parts(body)
            if params is not None:
                name = self.expand(name, depth, params).strip()
                if name in params:
                    return params[name]
            return self.expand(rest[0], depth, params) if rest else ""
        finally:
            self.inside -= 1

    def call(self, body: str, depth: int, params: dict[str, str] | None) -> str:
        if depth > MAX_DEPTH:
            return ""
        parts = split_parts(body)
        title = self.expand(parts[0].strip(), depth, params).strip()
        lazy = re.match(r"(?i)(safe)?subst:", title)
        if lazy:
            title = title[lazy.end() :]
        value = self.magic(title)
        if value is not None:
            return value
        colon = title.find(":")
        if colon > 1:
            name, first = title[:colon].strip().lower(), title[colon + 1 :].strip()
            if name == "#invoke" or name in FUNCTIONS:
                args = [self.expand(x, depth, params) if not lazy else x for x in parts[1:]]
                return self.expand(self.function(name, [first, *args]), depth, params)
        full = self.site.qualified(title)
        full = self.site.redirects.get(full, full)
        template = self.site.templates.get(full)
        if template is None:
            return ""
        own: dict[str, str] = {}
        nth = 0
        for raw in parts[1:]:
            text = raw if lazy else self.expand(raw, depth, params)
            name, has, value = text.partition("=") if re.match(r"\s*[^=\s][^=]*=", text) and "[[" not in text.split("=")[0] else ("", "", text)
            if has:
                own[name.strip()] = value if "]]" in value else value.strip()
            else:
                nth += 1
                own[str(nth)] = value if "]]" in value else value.strip()
        return self.expand(template, depth, own)

    def function(self, name: str, args: list[str]) -> str:
        try:
            if name == "#invoke":
                return MODULES[args[0].strip().lower()][args[1].strip()](*args[2:])
            return FUNCTIONS[name](*args)
        except Exception:
            return ""

    # --- cleaning -------------------------------------------------------------------------

    def clean(self, text: str, expand: bool = True) -> str:
        text = self.expand(text) if expand else drop_nested(text, r"\{\{", r"\}\}")
        text = drop_nested(text, r"\{\|", r"\|\}")
        text = self.external(text)
        text = self.internal(text)
        text = re.sub(r"__[A-Z]+__", "", text)
        pieces = re.split(r"(<syntaxhighlight.*?</syntaxhighlight>)", text, flags=re.S)
        text = "".join(p if i % 2 else unescape_text(p) for i, p in enumerate(pieces))
        text = self.quotes(text)
        cut = [m.span() for m in re.finditer(r"<!--.*?-->", text, re.S)]
        cut += [m.span() for t in SINGLE for m in re.finditer(rf"<\s*{t}\b[^>]*/\s*>|<\s*{t}\s*>(?=\s|$)" if t in ("br", "hr") else rf"<\s*{t}\b[^>]*/\s*>", text, re.I)]
        cut += [m.span() for t in [*UNWRAPPED, *([] if self.keep_links else ["a"])] for m in re.finditer(rf"<{t}\b[^>]*>|</\s*{t}>", text, re.I)]
        text = drop_spans(text, cut)
        for t in DROPPED:
            text = drop_nested(text, rf"(?i:<\s*{t}\b[^>/]*>)", rf"(?i:<\s*/\s*{t}>)")
        if not self.html:
            text = unescape_text(text)
        for t, name in NUMBERED.items():
            for i, (a, b) in reversed(list(enumerate([m.span() for m in re.finditer(rf"(?is)<\s*{t}\b[^>]*>.*?<\s*/\s*{t}\s*>", text)], 1))):
                text = f"{text[:a]}{name}_{i}{text[b:]}"
        text = text.replace("<<", "«").replace(">>", "»")
        text = re.sub(r" +", " ", text.replace("\t", " "))
        text = re.sub(r"\.{4,}", "...", text)
        text = re.sub(r"(?m)^[\W_]+$\n?", "", text) if re.search(r"\w", text) else text.strip()
        return text.replace(",,", ",").replace(",.", ".")

    def quotes(self, text: str) -> str:
        bold, italic = (r"<b>\1</b>", r"<i>\1</i>") if self.html else (r"\1", '"\\1"')
        text = re.sub(r"'''''(.*?)'''''", r"<b><i>\1</i></b>" if self.html else r"\1", text)
        text = re.sub(r"'''(.*?)'''", bold, text)
        text = re.sub(r"''\"([^\"]*)\"''", r'"\1"', text)
        text = re.sub(r"''(.*?)''", italic, text)
        return re.sub(r"'{2,}", "", text)

    def external(self, text: str) -> str:
        def one(m: re.Match) -> str:
            label = (m[2] or "").strip()
            return label if m[1].startswith("//") else f'<a href="{quote(m[1])}">{label}</a>' if self.keep_links else ""

        return re.sub(r"(?<!\[)\[((?:[a-z][a-z0-9+.-]*:|//)[^\s\]<>\"]*)(\s[^\]\n]*)?\](?!\])", one, text, flags=re.I)

    def internal(self, text: str) -> str:
        out, at = [], 0
        for a, b in spans(text, "[[", "]]"):
            if a < at:
                continue
            trail = re.match(r"\w*", text[b:])[0]
            title, *rest = split_parts(text[a + 2 : b - 2])
            label = self.internal(rest[-1]).strip() if rest else title.strip()
            out += [text[at:a], self.link(title.strip(), label), trail]
            at = b + len(trail)
        return "".join([*out, text[at:]])

    def link(self, title: str, label: str) -> str:
        space, colon, rest = title.partition(":")
        if colon and space.lower().strip() not in ACCEPTED:
            if space or rest.split(":")[0].lower() not in ACCEPTED and ":" in rest:
                return ""
            label = label.lstrip(":")
        return f'<a href="{quote(title)}">{label}</a>' if self.keep_links else label

    def compact(self, text: str) -> list[str]:
        """Lines of prose; section titles only before a section that has some."""
        out: list[str] = []
        pending: dict[int, str] = {}
        stack: list[str] = []

        def close(to: int = 0) -> None:
            while len(stack) > to:
                out.append("</ol>" if stack.pop() == "#" else "</ul>")

        for raw in text.split("\n"):
            line = raw.strip()
            head = re.match(r"^(==+)\s*(.*?)\s*(==+)$", line)
            if not line:
                continue
            if head:
                close()
                level, title = len(head[1]), head[2]
                pending = {k: v for k, v in pending.items() if k < level}
                pending[level] = f"<h{level}>{title}</h{level}>" if self.html else title if title[-1:] in "!?" else f"{title}."
                continue
            if line.startswith("++"):
                title = line[2:-2]
                out.append(title if title[-1:] in "!?" else f"{title}.")
                continue
            if line[0] in ":*#;":
                if self.html:
                    kind = "#" if line[0] == "#" else "*"
                    if not stack or stack[-1] != kind:
                        close()
                        stack.append(kind)
                        out.append("<ol>" if kind == "#" else "<ul>")
                    out.append(f"<li>{line.lstrip(':*#; ')}</li>")
                continue
            close()
            if line[0] in "{|" or line[-1] == "}" or (line[0] == "(" and line[-1] == ")") or not line.strip(".-"):
                continue
            if pending:
                if not self.keep_sections or self.html:
                    out += [pending[k] for k in sorted(pending)]
                pending = {}
            out.append(line)
        close()
        return out

    def text(self, wikitext: str, expand: bool = True) -> str:
        return "\n".join(self.compact(self.clean(wikitext, expand)))


# --- infobox ----------------------------------------------------------------------------------


def _clean_value(text: str) -> str:
    text = re.sub(r"<ref.*?(?:/>|</ref>)", "", text, flags=re.S)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", text)
    text = re.sub(r"<[^>]*>|\{\{|\}\}|'{2,}", " ", text)
    return re.sub(r"\s+", " ", text).strip()


def infobox(text: str | None, name: str = "infoboks") -> dict[str, str] | None:
    """Fields of the first infobox: names shorter than 20 characters, non-empty values; None without a complete one."""
    if text is None:
        return None
    boxes = re.split(rf"(?m)^\s*\{{\{{{re.escape(name)}.*$", re.sub(r"<!--.*?-->", "", text, flags=re.S).lower())
    if len(boxes) < 2:
        return None
    lines, body = boxes[1].split("\n"), []
    for line in lines:
        if "}}" in line and "{" not in line:
            break
        body.append(line)
    else:
        return None
    found = {}
    for part in re.split(r"(?m)^[^|\n]*\|", "\n".join(body))[1:]:
        key, has, value = part.partition("=")
        key, value = re.sub(r"\W", "_", _clean_value(key)), _clean_value(value)
        if has and value and len(key) < 20:
            found[key] = value
    return found


# --- on columns ---------------------------------------------------------------------------------


def site_of(templates: DataFrame, prefix: str = "Template:") -> Site:
    """A task's templates, from (title, text). A wiki's templates are few beside its pages; their size is checked."""
    size = templates.agg(F.sum(F.length("title") + F.length("text"))).first()[0] or 0
    if size > TEMPLATE_CHARS:
        raise ValueError(f"{size} characters of templates are more than {TEMPLATE_CHARS}, which a task may hold")
    site = Site(prefix=prefix)
    for r in templates.orderBy("title").toLocalIterator():
        site.define(r["title"], r["text"] or "")
    return site


def cleaned(text: Column, title: Column | None = None, site: Site | None = None, expand: bool = True, **options) -> Column:
    held = SparkSession.active().sparkContext.broadcast(site or Site())

    @F.pandas_udf(StringType())
    def run(texts: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else Page(held.value, n or "", **options).text(t, expand) for t, n in zip(texts, titles, strict=True)], dtype=object)

    return run(text, title if title is not None else F.lit(""))


@F.pandas_udf(MapType(StringType(), StringType()))
def infobox_map(text: pd.Series) -> pd.Series:
    return text.map(infobox)


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Visible text of an HTML page: scripts, styles, comments and tags go, references are decoded, white space is folded."""

    def one(h: str | None) -> str | None:
        if h is None:
            return None
        h = re.sub(r"(?is)<(script|style|head|nav)\b.*?</\1\s*>|<!--.*?-->", " ", h)
        return re.sub(r"\s+", " ", unescape_text(re.sub(r"(?s)<[^>]*>", " ", h))).strip()

    return html.map(one)


def ignore_tag(name: str) -> None:
    """Registers a tag whose marks go and whose content stays."""
    if name not in UNWRAPPED:
        UNWRAPPED.append(name)


# --- dumps ----------------------------------------------------------------------------------------

PAGE = "title string, ns int, id string, redirect struct<_title:string>, revision struct<id:string, parentid:string, contributor struct<id:string, username:string>, text struct<_VALUE:string>>"
PAGE = PAGE.replace("contributor struct", "contributor:struct").replace("text struct", "text:struct")


def dump(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a MediaWiki XML dump, bz2 or plain: ids (-1 where blank), title, ns, text."""
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").schema(PAGE).load(path)
    number = lambda c: F.coalesce(F.expr(f"try_cast(nullif(trim({c}), '') as bigint)"), F.lit(-1))
    return raw.select(
        number("id").alias("id"), "title", F.coalesce("ns", F.lit(0)).alias("ns"), number("revision.id").alias("revision_id"), number("revision.parentid").alias("revision_parentid"), number("revision.contributor.id").alias("contributor_id"), F.col("revision.text._VALUE").alias("text")
    )


def site_info(spark: SparkSession, path: str) -> dict:
    """base, and the prefix of templates (namespace 10), from the dump's head."""
    schema = "base string, namespaces struct<namespace:array<struct<_VALUE:string,_key:int>>>"
    row = spark.read.format("xml").option("rowTag", "siteinfo").option("ignoreNamespace", "true").schema(schema).load(path).first()
    names = {n["_key"]: n["_VALUE"] or "" for n in (row["namespaces"]["namespace"] if row and row["namespaces"] else [])}
    return {"base": row["base"].rsplit("/", 1)[0] if row and row["base"] else "", "namespaces": names, "template_prefix": f"{names.get(10, 'Template')}:"}


def pages(rows: DataFrame, num_articles: int = 0, min_length: int = 30, site: Site | None = None, **options) -> DataFrame:
    """Articles: no redirects, at most num_articles of them (0: all), cleaned, then those of at least min_length characters."""
    kept = rows.where(~F.coalesce(F.col("text"), F.lit("")).startswith("#REDIRECT"))
    if num_articles:
        kept = kept.limit(num_articles)
    made = kept.withColumn("infoboks", infobox_map("text")).withColumn("article", F.struct(cleaned(F.col("text"), F.col("title"), site, **options).alias("text")))
    return made.where(F.length("article.text") >= min_length)


def flat(rows: DataFrame, *paths: str, sep: str = "_") -> DataFrame:
    """Every leaf of nested structs as a column named by its path, or only the paths (with dots) that are named."""

    def leaves(fields, before=()):
        for f in fields:
            here = (*before, f.name)
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    found = [p for p in leaves(rows.schema) if not paths or ".".join(p) in paths]
    return rows.select(*(F.col(".".join(f"`{x}`" for x in p)).alias(sep.join(p)) for p in found))


def single_article(spark: SparkSession, path: str, site: Site | None = None, **options) -> dict | None:
    """id, title and text of the first article of one file, found by its marks alone: for looking at one page."""
    head = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-8").alias("x"))
    one = lambda pattern: F.regexp_extract("x", pattern, 1)
    row = head.select(one(r"<id>(\d+)</id>").alias("id"), one(r"<title>([^<]*)</title>").alias("title"), one(r"(?s)<text[^>]*>(.*?)</text>").alias("text")).first()
    if row is None or not row["title"]:
        return None
    return {"id": int(row["id"] or -1), "title": row["title"], "text": Page(site or Site(), row["title"], **options).text(unescape_text(row["text"]), True)}


def in_namespaces(rows: DataFrame, accepted: list[str] | None = None, template_prefix: str = "Template:") -> DataFrame:
    space = F.substring_index("title", ":", 1)
    fits = ~F.col("title").contains(":") | space.isin(accepted or sorted(ACCEPTED))
    return rows.where(fits & ~F.col("title").startswith(template_prefix) & ~F.coalesce(F.col("text"), F.lit("")).startswith("#REDIRECT"))


def templates(rows: DataFrame, prefix: str = "Template:") -> DataFrame:
    return rows.where(F.col("title").startswith(prefix)).select("title", "text")


def marked_up(rows: DataFrame, base: str = "") -> DataFrame:
    """One element per page: header with id, address and title, then the text."""
    url = F.concat(F.lit(f"{base}?curid="), F.col("id").cast("string"))
    return rows.select(F.concat(F.lit('<doc id="'), F.col("id").cast("string"), F.lit('" url="'), url, F.lit('" title="'), "title", F.lit('">\n'), "title", F.lit("\n\n"), F.col("article.text"), F.lit("\n</doc>\n")).alias("value"))
