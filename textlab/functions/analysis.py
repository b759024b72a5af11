"""Text analysis as Column expressions: character filters, tokenizers, token filters, analyzers.

An analyzer turns a text column into an array of tokens without leaving generated code. A
null text gives null tokens; a text without tokens an empty array. Positions are places in
the array, so removing a token by a filter closes the gap.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of letters, digits and marks; an apostrophe, full stop, colon or middle dot joins two.
WORD = r"[\p{L}\p{N}\p{M}_]+(?:['’.:·][\p{L}\p{N}\p{M}_]+)*"
ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()

_ACCENTS = ("àáâãäåāăąçćčďèéêëēęěìíîïīñńňòóôõöøōřśšťùúûüūůýÿžźżÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaaaacccdeeeeeeeiiiiinnnooooooorsstuuuuuuyyzzzAAAAAACEEEEIIIINOOOOOOUUUUY")

Filter = Callable[[Column], Column]
#: Scripts, styles, comments and tags.
HTML = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>"


# Character filters: text -> text


def html_strip(escaped: Mapping[str, str] | None = None) -> Filter:
    """Drop scripts, styles, comments and tags (each leaves a line end), decode common entities."""
    entities = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", **(escaped or {}), "&amp;": "&"}

    def build(text: Column) -> Column:
        out = F.regexp_replace(text, HTML, "\n")
        for a, b in entities.items():
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return build


def mapping(pairs: Mapping[str, str]) -> Filter:
    """Replace strings one after another."""

    def build(text: Column) -> Column:
        for a, b in pairs.items():
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    return build


def pattern_replace(pattern: str, replacement: str = "") -> Filter:
    return lambda text: F.regexp_replace(text, pattern, replacement)


# Tokenizers: text -> tokens


def standard(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def whitespace(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def keyword(text: Column) -> Column:
    return F.when(text.isNotNull(), F.array(text))


def letter(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{L}+"), F.lit(0))


def pattern(regex: str = r"\W+") -> Filter:
    """Split at matches."""
    return lambda text: F.filter(F.split(text, regex), lambda t: t != "")


def ngram(least: int = 1, most: int = 2) -> Filter:
    """All substrings of ``least`` to ``most`` characters, by place, then by length."""

    def build(text: Column) -> Column:
        n = F.length(text)
        at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        each = F.transform(at, lambda i: F.transform(F.array(*[F.lit(k) for k in range(least, most + 1)]), lambda k: F.when(i + k - 1 <= n, F.substring(text, i, k))))
        return F.when(text.isNotNull(), F.filter(F.flatten(each), lambda t: t.isNotNull()))

    return build


# Token filters: tokens -> tokens


def each(fn: Filter) -> Filter:
    return lambda tokens: F.transform(tokens, fn)


lowercase: Filter = each(F.lower)
uppercase: Filter = each(F.upper)
trim: Filter = each(F.trim)
reverse: Filter = each(F.reverse)
unique: Filter = F.array_distinct
asciifolding: Filter = each(lambda t: F.replace(F.replace(F.replace(F.translate(t, *_ACCENTS), F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe")))


def stop(words: Sequence[str] = ENGLISH_STOP) -> Filter:
    return lambda tokens: F.filter(tokens, lambda t: ~t.isin(list(words)))


def length(least: int = 0, most: int = 1 << 30) -> Filter:
    return lambda tokens: F.filter(tokens, lambda t: F.length(t).between(least, most))


def truncate(most: int = 10) -> Filter:
    return each(lambda t: F.substring(t, 1, most))


def edge_ngram(least: int = 1, most: int = 2) -> Filter:
    """Beginnings of ``least`` to ``most`` characters of every token."""

    def build(tokens: Column) -> Column:
        return F.flatten(F.transform(tokens, lambda t: F.transform(F.filter(F.array(*[F.lit(k) for k in range(least, most + 1)]), lambda k: k <= F.length(t)), lambda k: F.substring(t, F.lit(1), k))))

    return build


CHAR_FILTERS: dict[str, Filter] = {"html_strip": html_strip()}
TOKENIZERS: dict[str, Filter] = {"standard": standard, "whitespace": whitespace, "keyword": keyword, "letter": letter, "pattern": pattern(), "lowercase": lambda t: letter(F.lower(t)), "ngram": ngram()}
TOKEN_FILTERS: dict[str, Filter] = {
    "lowercase": lowercase, "uppercase": uppercase, "asciifolding": asciifolding, "stop": stop(), "length": length(), "unique": unique,
    "trim": trim, "reverse": reverse, "truncate": truncate(), "edge_ngram": edge_ngram(),
}
#: Parts that take settings, by kind and type.
FACTORIES: dict[str, dict[str, Callable[..., Filter]]] = {
    "char_filter": {"html_strip": lambda: html_strip(), "mapping": lambda mappings: mapping(dict(m.split("=>", 1) if isinstance(m, str) else m for m in mappings)), "pattern_replace": pattern_replace},
    "tokenizer": {"pattern": pattern, "ngram": lambda min_gram=1, max_gram=2: ngram(min_gram, max_gram)},
    "filter": {"stop": lambda stopwords=ENGLISH_STOP: stop(stopwords), "length": lambda min=0, max=1 << 30: length(min, max), "truncate": lambda length=10: truncate(length), "edge_ngram": lambda min_gram=1, max_gram=2: edge_ngram(min_gram, max_gram)},
}


@dataclass(frozen=True)
class Analyzer:
    """A chain; calling it gives the tokens of a text column."""

    tokenizer: Filter = standard
    filters: Sequence[Filter] = ()
    char_filters: Sequence[Filter] = ()

    def __call__(self, text: Column) -> Column:
        for f in self.char_filters:
            text = f(text)
        tokens = self.tokenizer(text)
        for f in self.filters:
            tokens = f(tokens)
        return tokens


@dataclass(frozen=True)
class _Standard(Analyzer):
    """Small letters are made before matching: one pass instead of a loop over tokens."""

    def __call__(self, text: Column) -> Column:
        return standard(F.lower(text))


BUILT_IN: dict[str, Analyzer] = {
    "standard": _Standard(),
    "default": _Standard(),
    "whitespace": Analyzer(whitespace),
    "keyword": Analyzer(keyword),
    "simple": Analyzer(TOKENIZERS["lowercase"]),
    "stop": Analyzer(TOKENIZERS["lowercase"], (stop(),)),
    "pattern": Analyzer(pattern(), (lowercase,)),
}


class UnknownPart(ValueError):
    """A name that no registry has."""


def _part(kind: str, name: str, known: Mapping[str, Filter], defined: Mapping[str, Filter]) -> Filter:
    if name in defined:
        return defined[name]
    if name in known:
        return known[name]
    raise UnknownPart(f"failed to find {kind} [{name}]")


@dataclass
class Registry:
    """Named analyzers; definitions are replaced as a whole, after all of the new ones are valid."""

    defined: dict[str, Analyzer] = field(default_factory=dict)

    def get(self, name: str | None = None) -> Analyzer:
        name = name or "default"
        if name in self.defined:
            return self.defined[name]
        if name in BUILT_IN:
            return BUILT_IN[name]
        raise UnknownPart(f"failed to find analyzer [{name}]")

    def update(self, settings: Mapping[str, Mapping[str, Mapping]]) -> None:
        """Replace all definitions; ``settings`` has ``analyzer``, ``tokenizer``, ``filter`` and ``char_filter``, each by name.

        On any error the old definitions stay.
        """
        parts: dict[str, dict[str, Filter]] = {}
        for kind in ("char_filter", "tokenizer", "filter"):
            parts[kind] = {}
            for name, body in settings.get(kind, {}).items():
                made = FACTORIES[kind].get(body.get("type", ""))
                if made is None:
                    raise UnknownPart(f"unknown {kind} type [{body.get('type')}] for [{name}]")
                parts[kind][name] = made(**{k: v for k, v in body.items() if k != "type"})
        built = {}
        for name, body in settings.get("analyzer", {}).items():
            if body.get("type", "custom") != "custom":
                if body["type"] not in BUILT_IN:
                    raise UnknownPart(f"failed to find analyzer [{body['type']}]")
                built[name] = BUILT_IN[body["type"]]
                continue
            if "tokenizer" not in body:
                raise ValueError(f"analyzer [{name}] must have a tokenizer")
            built[name] = chain(body["tokenizer"], body.get("filter", ()), body.get("char_filter", ()), parts)
        self.defined = built


def chain(tokenizer: str, filters: Sequence[str] = (), char_filters: Sequence[str] = (), defined: Mapping[str, Mapping[str, Filter]] | None = None) -> Analyzer:
    """An analyzer of named parts."""
    own = defined or {}
    listed = lambda x: [x] if isinstance(x, str) else list(x)
    return Analyzer(
        _part("tokenizer", tokenizer, TOKENIZERS, own.get("tokenizer", {})),
        tuple(_part("token filter", f, TOKEN_FILTERS, own.get("filter", {})) for f in listed(filters)),
        tuple(_part("char filter", f, CHAR_FILTERS, own.get("char_filter", {})) for f in listed(char_filters)),
    )


REGISTRY = Registry()


def resolve(analyzer: str | Analyzer | None = None, tokenizer: str | None = None, filters: Sequence[str] = (), char_filters: Sequence[str] = (), registry: Registry = REGISTRY) -> Analyzer:
    """The analyzer that is named, or else the chain, or else the default."""
    if isinstance(analyzer, Analyzer):
        return analyzer
    if analyzer is not None:
        return registry.get(analyzer)
    if tokenizer is not None:
        return chain(tokenizer, filters, char_filters)
    return registry.get()


def tokens_of(df: DataFrame, name: str, analyzer: str | Analyzer | None = None, registry: Registry = REGISTRY) -> Column:
    """The tokens of a text column, or of all values of an array of texts one after another."""
    column, kind = F.col(name), df.select(name).schema[0].dataType
    a = resolve(analyzer, registry=registry)
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.transform(F.filter(column, lambda x: x.isNotNull()), a))
    return a(column.cast("string"))


def analyzed_text(df: DataFrame, name: str, target: str = "analyzed_text", analyzer: str | Analyzer | None = None, tokenizer: str | None = None, filters: Sequence[str] = (), char_filters: Sequence[str] = ()) -> DataFrame:
    """The table with the tokens of a column in another."""
    if name not in df.columns and "." not in name:
        raise ValueError(f"field [{name}] not found")
    return df.withColumn(target, tokens_of(df, name, resolve(analyzer, tokenizer, filters, char_filters)))


def python_pattern(analyzer: str) -> re.Pattern:
    """The pattern of the tokens of an analyzer, for offsets."""
    import regex

    found = {"standard": WORD, "default": WORD, "whitespace": r"\S+", "keyword": r"(?s).+", "simple": r"\p{L}+", "letter": r"\p{L}+"}
    if analyzer not in found:
        raise ValueError(f"offsets are not available for analyzer [{analyzer}]")
    return regex.compile(found[analyzer])
