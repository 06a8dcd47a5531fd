"""Column functions on texts: lines, masking, entropy, redaction, paths, tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

# Credential forms that redaction looks for.
SENSITIVE_KEY = r"(?i)(?:^|_)(?:api_?key|access_?key|auth(?:orization)?|bearer|client_?secret|cookie|credential|database_?url|password|passwd|private_?key|refresh_?token|secret|session|token)(?:$|_)"
TOKEN_FORMS = (
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]{8,}",
    r"\bAKIA[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{20,}\b",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
)
ASSIGNMENT = r"""(?i)(\b(?:api[_-]?key|access[_-]?token|authorization|client[_-]?secret|database[_-]?url|password|passwd|private[_-]?key|refresh[_-]?token|secret|token)\s*[:=]\s*)("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|[^\s,;]+)"""
URI_CREDENTIAL = r"(?i)\b([a-z][a-z0-9+.-]*://)([^\s/@:]+):([^\s/@]+)@"
RUNNER_FORMS = (
    (r"(?i)(bearer\s+)[A-Za-z0-9._~+/-]{8,}", "$1[REDACTED]"),
    (r"(?i)((?:token|secret|password|api[_-]?key)\s*[=:]\s*)[^\s]+", "$1[REDACTED]"),
    (r"(?i)(://[^\s:@/]+:)[^\s@/]+(@)", "$1[REDACTED]$2"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED]"),
    (r"AKIA[0-9A-Z]{16}", "[REDACTED]"),
)
# Words that mark a placeholder, and words that no token is made of.
PLACEHOLDER_WORDS = ("changeme", "dummy", "example", "fake", "not-a-real", "placeholder", "replace-me", "replace_me", "sample", "test-token", "your-token", "your_token")
STOP_WORDS = ("and", "for", "from", "into", "must", "should", "that", "the", "this", "with")


def line_of(text: Column, part: Column) -> Column:
    """Line, from 1 on, on which the part first occurs."""
    before = F.call_function("substring_index", text, part, F.lit(1))
    return F.regexp_count(before, F.lit("\n")) + 1


def lines(text: Column) -> Column:
    """Lines as an editor counts them; a break at the end opens no further line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def shannon_entropy(value: Column) -> Column:
    """Bits for a character; 0 for an empty text."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda t, p: t - p * F.log2(p))


def is_placeholder(value: Column) -> Column:
    """Holds a placeholder word, has three different letters or digits at most, or is made of abc, 123 and xyz."""
    low = F.lower(value)
    compact = F.regexp_replace(low, "[^a-z0-9]", "")
    few = F.size(F.array_distinct(F.filter(F.split(compact, ""), lambda c: c != ""))) <= 3
    return low.rlike("|".join(PLACEHOLDER_WORDS)) | few | compact.rlike("^(?:abc|123|xyz)+$")


def mask(value: Column) -> Column:
    n = F.length(value)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(4)), F.repeat(F.lit("*"), F.least(F.lit(12), n - 7)), F.right(value, F.lit(3))))


def redact_text(text: Column, known: tuple[str, ...] = ()) -> Column:
    """Known secrets of four characters or more (longest first), then credentials in addresses, assignments and token forms."""
    out = reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(REDACTED)), sorted({s for s in known if len(s) >= 4}, key=lambda s: (-len(s), s)), text)
    out = F.regexp_replace(out, URI_CREDENTIAL, "$1[REDACTED]@")
    out = F.regexp_replace(out, ASSIGNMENT, "$1[REDACTED]")
    return reduce(lambda t, p: F.regexp_replace(t, p, REDACTED), TOKEN_FORMS, out)


def leaks(text: Column) -> Column:
    """Whether a credential is still readable."""
    forms = reduce(lambda a, p: a | text.rlike(p), TOKEN_FORMS, text.rlike(URI_CREDENTIAL))
    return forms | F.exists(F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(2)), lambda v: ~v.contains(REDACTED))


def redact_output(text: Column) -> Column:
    """Redaction of what a command has printed."""
    return reduce(lambda t, p: F.regexp_replace(t, *p), RUNNER_FORMS, text)


def truncate_output(text: Column, limit: int) -> Column:
    """Head and tail of a text of more than limit bytes; a character that a cut parts becomes the replacement character."""
    half = max(1, (limit - 64) // 2)
    data = F.encode(text, "UTF-8")
    head, tail = F.substring(data, 1, half), F.substring(data, F.octet_length(text) - half + 1, F.lit(half))
    safe = lambda b: F.make_valid_utf8(b.cast("string"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(safe(head), F.lit("\n...[output truncated]...\n"), safe(tail)))


def sensitive_key(key: Column) -> Column:
    parted = F.regexp_replace(key, r"(?<=[a-z0-9])(?=[A-Z])", "_")
    return F.regexp_replace(F.regexp_replace(parted, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "").rlike(SENSITIVE_KEY)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The last dotted part of the name with its dot; none for names that only start or end with a dot."""
    return F.regexp_extract(basename(path), r"[^.].*?(\.[^.]+)$", 1)


def module_name(path: Column) -> Column:
    """Dotted module of a source path: the suffix .py and a last part __init__ go."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\.py$", ""), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts), ".")


def tokens(text: Column) -> Column:
    """Lower-case identifiers of two characters or more and runs of CJK characters (three or more as pairs), without stop words."""
    raw = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z][a-z0-9_/-]+|[\u4e00-\u9fff]{2,})"), F.lit(1))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))
    parts = F.transform(raw, lambda t: F.when(t.rlike(r"^[\u4e00-\u9fff]{3,}$"), pairs(t)).otherwise(F.array(t)))
    return F.filter(F.flatten(parts), lambda t: ~t.isin(*STOP_WORDS))


def version_numbers(spec: Column) -> Column:
    """The first three whole numbers of a version."""
    return F.transform(F.slice(F.regexp_extract_all(spec, F.lit(r"(\d+)"), F.lit(1)), 1, 3), lambda x: x.cast("long"))


def version_direction(previous: Column, current: Column) -> Column:
    old, new = version_numbers(previous), version_numbers(current)
    both = (F.size(old) > 0) & (F.size(new) > 0)
    return F.when(both & (new > old), "upgraded").when(both & (new < old), "downgraded").otherwise("modified")


def is_unpinned(spec: Column) -> Column:
    v = F.lower(F.trim(F.coalesce(spec, F.lit(""))))
    return (v == "") | v.isin("*", "latest") | v.rlike("^[\\^~><]") | v.contains(",")
