"""The query language: words, statements, and their plans.

A statement is a line of words. Keywords are case-insensitive; ``dim:value`` is a reference, split at the
first colon; whole numbers are numbers; anything else is a name. A comma may follow a word, a semicolon
the statement; words after a complete statement are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

KEYWORDS = frozenset(
    "ACROSS AND AS AT BETWEEN BOTTOM BY CMI COMPARE CORRELATIONS CSV DIMENSIONS ENTROPY EXPLAIN EXPORT FROM GIVEN GRANULARITY JSON LIMIT MI NEAREST ON OVER PAIRWISE RANK SCHEMA SHOW STATS TOP TRACK USING VS WHERE".split()
)


class QueryError(ValueError):
    """Text that is no statement."""


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, ref, number, name, comma, end
    text: str = ""
    value: str = ""


@dataclass(frozen=True)
class Ref:
    """``parts``: the pairs of a reference; a slash joins several, and ``variable:`` names a variable."""

    dimension: str
    value: str

    def parse(self) -> tuple[dict[str, str], str | None]:
        return parse_reference(f"{self.dimension}:{self.value}")


def parse_reference(text: str) -> tuple[dict[str, str], str | None]:
    """{dimension: value} and the variable, if it is named."""
    key: dict[str, str] = {}
    variable = None
    for part in text.split("/"):
        name, colon, value = part.partition(":")
        if not colon or not name or not value:
            raise QueryError(f"not a reference: '{text}'")
        if name == "variable":
            variable = value
        else:
            key[name] = value
    return key, variable


@dataclass(frozen=True)
class Statement:
    kind: str
    variable: str = ""
    other: str = ""
    a: Ref | None = None
    b: Ref | None = None
    dimension: str | None = None
    where: tuple[Ref, ...] = ()
    limit: int | None = None
    order: str | None = None  # top or bottom
    metric: str = "jsd"
    granularity: str | None = None
    format: str = ""
    inner: Statement | None = field(default=None)


def tokenize(text: str) -> list[Token]:
    out: list[Token] = []
    for word in text.strip().rstrip(";").split():
        comma = word.endswith(",") and len(word) > 1
        word = word[:-1] if comma else word
        if word == ",":
            out.append(Token("comma"))
            continue
        if word.upper() in KEYWORDS:
            out.append(Token("keyword", word.upper(), word))
        elif ":" in word:
            name, _, value = word.partition(":")
            if not name or not value:
                raise QueryError(f"a reference needs both sides: '{word}'")
            out.append(Token("ref", name, value))
        elif word.isascii() and word.lstrip("+").isdigit():
            out.append(Token("number", word.lstrip("+")))
        else:
            out.append(Token("name", word))
        if comma:
            out.append(Token("comma"))
    return [*out, Token("end")]


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self, kind: str, text: str = "") -> Token:
        t = self.now
        if t.kind != kind or (text and t.text != text):
            raise QueryError(f"expected {text or kind}, found {t.text or t.kind}")
        self.at += 1
        return t

    def word(self, *texts: str) -> str | None:
        """The keyword, if one of these is next."""
        if self.now.kind == "keyword" and self.now.text in texts:
            self.at += 1
            return self.tokens[self.at - 1].text
        return None

    def name(self) -> str:
        return self.take("name").text

    def number(self) -> int:
        return int(self.take("number").text)

    def ref(self) -> Ref:
        t = self.take("ref")
        return Ref(t.text, t.value)

    def where(self) -> tuple[Ref, ...]:
        if not self.word("WHERE"):
            return ()
        out = [self.ref()]
        while self.word("AND"):
            out.append(self.ref())
        return tuple(out)

    def pair(self) -> tuple[str, str]:
        a = self.name()
        if self.now.kind == "comma":
            self.at += 1
        return a, self.name()

    def statement(self) -> Statement:
        kind = self.take("keyword").text
        rule = getattr(self, f"_{kind.lower()}", None)
        if rule is None:
            raise QueryError(f"no statement begins with {kind}")
        return rule()

    def _compare(self) -> Statement:
        v = self.name()
        if self.word("BETWEEN"):
            a = self.ref()
            self.take("keyword", "AND")
            return Statement("compare", v, a=a, b=self.ref(), where=self.where())
        self.take("keyword", "ACROSS")
        return Statement("across", v, dimension=self.name(), where=self.where())

    def _explain(self) -> Statement:
        a = self.ref()
        self.take("keyword", "VS")
        return Statement("explain", a=a, b=self.ref())

    def _track(self) -> Statement:
        v = self.name()
        self.take("keyword", "FROM")
        a = self.ref()
        return Statement("track", v, a=a, granularity=self.name() if self.word("GRANULARITY") else None)

    def _show(self) -> Statement:
        v = self.name()
        self.take("keyword", "AT")
        a, where = self.ref(), self.where()
        order = self.word("TOP", "BOTTOM")
        return Statement("show", v, a=a, where=where, order=order.lower() if order else None, limit=self.number() if order else None)

    def _rank(self) -> Statement:
        v = self.name()
        for k in ("BY", "ENTROPY", "OVER"):
            self.take("keyword", k)
        return Statement("rank", v, dimension=self.name(), where=self.where())

    def _mi(self) -> Statement:
        a, b = self.pair()
        self.take("keyword", "AT")
        return Statement("mi", a, b, a=self.ref())

    def _cmi(self) -> Statement:
        a, b = self.pair()
        self.take("keyword", "GIVEN")
        return Statement("cmi", a, b, dimension=self.name())

    def _correlations(self) -> Statement:
        dimension, limit = None, 20
        while k := self.word("OVER", "LIMIT"):
            dimension, limit = (self.name(), limit) if k == "OVER" else (dimension, self.number())
        return Statement("correlations", dimension=dimension, limit=limit)

    def _pairwise(self) -> Statement:
        dimension = self.name()
        self.take("keyword", "ON")
        v = self.name()
        return Statement("pairwise", v, dimension=dimension, metric=self.name() if self.word("USING") else "jsd")

    def _nearest(self) -> Statement:
        a = self.ref()
        self.take("keyword", "ON")
        dimension, limit, metric = self.name(), 3, "jsd"
        while k := self.word("LIMIT", "USING"):
            limit, metric = (self.number(), metric) if k == "LIMIT" else (limit, self.name())
        return Statement("nearest", a=a, dimension=dimension, limit=limit, metric=metric)

    def _export(self) -> Statement:
        inner = self.statement()
        self.take("keyword", "AS")
        kind = self.word("CSV", "JSON")
        if not kind:
            raise QueryError("EXPORT is AS CSV or AS JSON")
        return Statement("export", inner=inner, format=kind.lower())

    def _stats(self) -> Statement:
        return Statement("stats")

    def _schema(self) -> Statement:
        return Statement("schema")

    def _dimensions(self) -> Statement:
        return Statement("dimensions", dimension=self.name() if self.now.kind == "name" else None)


def parse(text: str) -> Statement:
    return Parser(text).statement()
