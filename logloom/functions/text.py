"""Text scalars: search tokens, host names, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (public full-text defaults of the reference's database): the
# minimum indexed word length and the default stop-word list.
MIN_TOKEN_LENGTH = 3
DEFAULT_STOPWORDS = (
    "a", "about", "an", "are", "as", "at", "be", "by", "com", "de", "en", "for",
    "from", "how", "i", "in", "is", "it", "la", "of", "on", "or", "that", "the",
    "this", "to", "was", "what", "when", "where", "who", "will", "with", "und", "www",
)

# A word is a run of letters, digits or underscores.
WORD_SPLIT = r"[^\p{L}\p{N}_]+"

# Columns covered by the full-text index, in index order.
SEARCH_COLUMNS = ("app", "address", "message", "logger", "thread", "stacktrace")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str, stopwords: Sequence[str] = DEFAULT_STOPWORDS,
           min_length: int = MIN_TOKEN_LENGTH) -> Column:
    """Lower-cased words of at least ``min_length`` chars, stop words removed."""
    words = F.split(F.lower(_col(c)), WORD_SPLIT)
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else F.array().cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) >= min_length) & ~F.array_contains(stop, w))


def distinct_tokens(c: Column | str, stopwords: Sequence[str] = DEFAULT_STOPWORDS) -> Column:
    """The distinct words of a text without stop words, words below the minimum
    length (and an empty one) among them: without a lambda, so it is compiled.
    To be cut by ``length >= MIN_TOKEN_LENGTH`` once the words are rows."""
    words = F.split(F.lower(_col(c)), WORD_SPLIT)
    return F.array_except(words, F.array(*[F.lit(w) for w in stopwords])) if stopwords else F.array_distinct(words)


def search_text(columns: Sequence[str] = SEARCH_COLUMNS) -> Column:
    """The indexed columns joined by spaces (nulls skipped)."""
    return F.concat_ws(" ", *[F.col(c) for c in columns])


def top_domain(c: Column | str) -> Column:
    """Last two dot-separated parts, cut at the first ``:`` or ``/``.

    ``aa.b.com`` → ``b.com``, ``aaa`` → ``aaa``, ``ok.dom.com:443/aaa`` →
    ``dom.com``; trailing empty parts are ignored.
    """
    parts = F.split(F.regexp_replace(_col(c), r"\.+$", ""), r"\.")
    last_two = F.when(F.size(parts) >= 2, F.slice(parts, -2, 2)).otherwise(parts)
    return F.regexp_extract(F.array_join(last_two, "."), r"^[^:/]*", 0)


def source_label(name: Column | str, client_id: Column | str) -> Column:
    """``name (id)``, or just the name without a client id."""
    name, client_id = _col(name), _col(client_id)
    return F.when(client_id.isNull(), name).otherwise(F.concat(name, F.lit(" ("), client_id, F.lit(")")))


def trimmed(c: Column | str) -> Column:
    """Without the leading and trailing characters up to U+0020 (tabs, line
    feeds and other controls as well as spaces)."""
    return F.regexp_replace(_col(c), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def is_blank(c: Column | str) -> Column:
    """Empty or nothing but white space (of any script); null for null."""
    return _col(c).rlike(r"^\p{javaWhitespace}*$") | (trimmed(c) == "")


def clean_name(c: Column | str) -> Column:
    """App names and client ids: blank → null, else trimmed."""
    return F.when(~is_blank(c), trimmed(c))


def clean_agent(c: Column | str) -> Column:
    """User agents: blank → null, else trimmed and cut to 100 chars."""
    return F.when(~is_blank(c), F.substring(trimmed(c), 1, 100))
