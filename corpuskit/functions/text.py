"""Text predicates and projections as Spark column expressions.

Everything here stays inside whole-stage codegen (no Python UDF): string
functions, ``rlike``, higher-order array functions.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "PERSIAN_LETTERS", "LATIN_ACCENT_LETTERS", "PY_WHITESPACE", "TEXT_FIELDS",
    "FRIENDLY_WORDS", "CREATIVE_MARKS", "EMOJI_MARKS", "FALLBACK_RESPONSES",
    "PLAIN_FALLBACK", "ROUTE_PREFIX_SCRIPT", "ROUTE_PREFIX_OTHER",
    "col_of", "ustrip", "char_class", "has_script", "min_stripped_len", "plain_fallback",
    "is_valid_text", "usable_string", "has_ascii_alpha", "script_class", "candidate_ok",
    "contains_any", "tokens", "word_count", "html_escape", "category_title",
    "render_template", "strip_echo_all", "strip_echo_prefix", "route_prompt", "clean_input", "preview",
    "hash_pick", "fallback_response", "stamp", "thousands_text", "percent_text",
]

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# The 32-letter script alphabet used by every "is it Persian" test.
PERSIAN_LETTERS = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهی"
# Characters Python's str.strip()/str.split() treat as whitespace.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Field names probed, in order, after the configured field.
TEXT_FIELDS = ("text", "content", "article", "body", "paragraph", "document", "main_text")
# Response-metric lexicons.
FRIENDLY_WORDS = ("سلام", "لطفا", "خوشحال", "کمک", "دوست", "خوش", "ممنون", "عالی")
CREATIVE_MARKS = ("!", "؟", "...", "✨", "😊", "🌟", "🎯")
EMOJI_MARKS = ("😊", "😂", "❤️", "✨", "🌟", "🎯", "🧠")
# Canned answers when no candidate passes the gate (personality variant) and
# the constant of the plain variant.
FALLBACK_RESPONSES = (
    "سلام! متأسفانه در حال حاضر نمی‌تونم به درخواست شما پاسخ بدم. لطفاً کمی بعد تلاش کنید! 😊",
    "اوه! به نظر می‌رسه مشکلی پیش اومده. می‌تونید سوال خودتون رو دوباره بپرسید؟",
    "ببخشید، نتونستم متوجه بشم. لطفاً سوال خودتون رو به فارسی واضح‌تر بپرسید! 🌟",
)
PLAIN_FALLBACK = "No response generated"
# Instruction prefixes of the console variant's language routing.
ROUTE_PREFIX_SCRIPT = "لطفاً به سوال زیر پاسخ دهید: "
ROUTE_PREFIX_OTHER = "Please answer the following question: "
# ---------------------------------------------------------------------------

# Profile for the Latin-script driver tables (no Persian letter occurs there).
LATIN_ACCENT_LETTERS = "éèêçäöüßñáíóú"

_WS_CLASS = "[" + PY_WHITESPACE + "]"


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ustrip(c) -> Column:
    """Unicode-aware ``str.strip()``: Spark's ``trim`` only removes ASCII space."""
    return F.btrim(col_of(c), F.lit(PY_WHITESPACE))


def char_class(letters: str) -> str:
    """A regex character class matching any of ``letters`` (class chars escaped)."""
    esc = "".join("\\" + ch if ch in "\\]^-[" else ch for ch in letters)
    return "[" + esc + "]"


def has_script(c, letters: str = PERSIAN_LETTERS) -> Column:
    """At least one letter of the alphabet occurs (NULL -> false)."""
    return F.coalesce(col_of(c).rlike(char_class(letters)), F.lit(False))


def min_stripped_len(c, n: int = 25) -> Column:
    """Stripped length >= n code points.  A string of >= 4n bytes has >= n
    code points (UTF-8 uses <= 4 bytes each), which skips counting long texts."""
    s = ustrip(c)
    return F.coalesce((F.octet_length(s) >= 4 * n) | (F.length(s) >= n), F.lit(False))


def plain_fallback(c) -> Column:
    """Long enough (unstripped), not markup/JSON-looking, no link."""
    x = col_of(c)
    return F.coalesce(
        ((F.octet_length(x) > 400) | (F.length(x) > 100)) & ~x.startswith("{") & ~x.startswith("[") & ~x.startswith("<")
        & ~x.contains("http"),
        F.lit(False))


def is_valid_text(c, letters: str = PERSIAN_LETTERS, min_len: int = 25) -> Column:
    """Text gate: stripped length >= min_len and (script letter or plain fallback)."""
    return min_stripped_len(c, min_len) & (has_script(c, letters) | plain_fallback(c))


def usable_string(c) -> Column:
    """Truthy string: non-null and non-empty (whitespace-only passes)."""
    x = col_of(c)
    return F.coalesce(x.isNotNull() & (x != ""), F.lit(False))


def has_ascii_alpha(c) -> Column:
    return F.coalesce(col_of(c).rlike("[A-Za-z]"), F.lit(False))


def script_class(c) -> Column:
    """``english`` when any ASCII letter occurs, else ``persian``."""
    return F.when(has_ascii_alpha(c), F.lit("english")).otherwise(F.lit("persian"))


def candidate_ok(c, letters: str = PERSIAN_LETTERS, min_len: int = 10) -> Column:
    """Candidate gate: longer than ``min_len`` code points and has a script letter."""
    return F.coalesce(F.length(col_of(c)) > min_len, F.lit(False)) & has_script(c, letters)


def contains_any(c, terms: Iterable[str]) -> Column:
    """Plain, case-sensitive substring containment of any term."""
    x = col_of(c)
    parts = [x.contains(t) for t in terms]
    if not parts:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, parts), F.lit(False))


_SPACES = " " * len(PY_WHITESPACE)


def tokens(c) -> Column:
    """``str.split()``: whitespace-separated tokens, no empty tokens.

    Every whitespace character is mapped to a space (``translate``, a code
    point table), then split on the single space (Java's non-regex fast path)
    and empty strings removed: about 2x faster than a regex split."""
    return F.array_remove(F.split(F.translate(col_of(c), PY_WHITESPACE, _SPACES), " "), "")


def word_count(c) -> Column:
    return F.size(tokens(c))


def html_escape(c) -> Column:
    """Escape ``& < > " '`` (``&`` first; quote as ``&#x27;``)."""
    x = col_of(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def category_title(c) -> Column:
    """``snake_case`` heading to ``Title Case`` words."""
    return F.initcap(F.replace(col_of(c), F.lit("_"), F.lit(" ")))


def render_template(body, prompt, system=None) -> Column:
    """Fill ``{system}`` then ``{prompt}`` holes (prompt last, so a prompt that
    itself contains ``{system}`` is kept verbatim)."""
    out = col_of(body)
    if system is not None:
        out = F.replace(out, F.lit("{system}"), col_of(system) if not isinstance(system, str) else F.lit(system))
    return F.replace(out, F.lit("{prompt}"), col_of(prompt))


def strip_echo_all(output, prompt) -> Column:
    """Remove every occurrence of the prompt, then strip."""
    o, p = col_of(output), col_of(prompt)
    return F.when(p.isNull() | (p == ""), ustrip(o)).otherwise(ustrip(F.replace(o, p, F.lit(""))))


def strip_echo_prefix(output, prompt) -> Column:
    """If the output starts with the prompt, cut it and strip; else unchanged."""
    o, p = col_of(output), col_of(prompt)
    return F.when(o.startswith(p), ustrip(F.substr(o, F.length(p) + 1))).otherwise(o)


def route_prompt(c, letters: str = PERSIAN_LETTERS, script_prefix: str = ROUTE_PREFIX_SCRIPT,
                 other_prefix: str = ROUTE_PREFIX_OTHER) -> Column:
    """Strip the input and prepend the instruction for its language."""
    x = ustrip(c)
    return F.when(has_script(x, letters), F.concat(F.lit(script_prefix), x)) \
        .otherwise(F.concat(F.lit(other_prefix), x))


def clean_input(c) -> Column:
    """Stripped user input; empty input becomes NULL (to be filtered)."""
    x = ustrip(c)
    return F.when(x != "", x)


def preview(c, n: int) -> Column:
    return F.concat(F.substring(col_of(c), 1, n), F.lit("..."))


def hash_pick(key, n: int) -> Column:
    """Deterministic 0-based pick in [0, n) from the md5 of ``key`` (first 8 hex
    digits), portable to any SQL engine with md5."""
    h = F.conv(F.substring(F.md5(col_of(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n))


def fallback_response(prompt, choices: Sequence[str] = FALLBACK_RESPONSES) -> Column:
    arr = F.array(*[F.lit(s) for s in choices])
    return F.element_at(arr, (hash_pick(prompt, len(choices)) + 1).cast("int"))


def stamp(ts) -> Column:
    """Checkpoint-name stamp ``yyyyMMdd_HHmmss``."""
    return F.date_format(col_of(ts), "yyyyMMdd_HHmmss")


def thousands_text(value) -> Column:
    """Integer with thousands separators (``{n:,}``)."""
    return F.format_number(col_of(value), 0)


def percent_text(name, value) -> Column:
    """``name: 12.3%`` lines of the metrics file."""
    return F.format_string("%s: %.1f%%", col_of(name), col_of(value))
