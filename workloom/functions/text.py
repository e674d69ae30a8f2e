"""Text protection as Column expressions: comments, injection patterns, error scrubbing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twelve injection patterns, in the order in which they are applied.
INJECTION_PATTERNS = (
    r"(?i)(system|assistant|user)\s*:",
    r"(?i)ignore\s+(all\s+)?(previous|prior|above)",
    r"(?i)new\s+instruction",
    r"(?i)override\s+system",
    r"(?i)disregard\s+(all\s+)?violations?",
    r"\{\{.*?\}\}",
    r"(?i)you\s+are\s+now",
    r"(?i)from\s+now\s+on",
    r"(?i)forget\s+(all\s+)?(previous|prior)",
    r"(?i)act\s+as",
    r"(?i)pretend\s+to\s+be",
    r"(?i)role\s*:\s*(system|assistant)",
)

# Hits on these three make an attempt critical.
CRITICAL_PATTERNS = (INJECTION_PATTERNS[0], INJECTION_PATTERNS[11], INJECTION_PATTERNS[3])

# Replacement chain for error messages (pattern, replacement), in order.
ERROR_SCRUBS = (
    (r"(/[\w/.-]+|[A-Z]:\\[\w\\.-]+)", "[PATH]"),
    (r"(?i)line \d+", "line [N]"),
    (r"at 0x[0-9a-fA-F]+", "at [ADDRESS]"),
    (r"in module ['\"][\w.]+['\"]", "in module [MODULE]"),
    (r"module ['\"][\w.]+['\"] has no", "module [MODULE] has no"),
    (r"named ['\"][\w.]+['\"]", "named [MODULE]"),
    (r'File ".*?"', 'File "[REDACTED]"'),
    (r"(?i)(sk-|api[_-]?key[_-]?)[a-zA-Z0-9_-]{20,}", "$1[REDACTED]"),
)

# The friendly sentence put before a scrubbed message, by error type.
FRIENDLY_ERRORS = {
    "FileNotFoundError": "File or directory not found",
    "PermissionError": "Permission denied to access resource",
    "ValueError": "Invalid value provided",
    "TypeError": "Invalid type in operation",
    "ImportError": "Failed to import required module",
    "ModuleNotFoundError": "Required module not installed",
    "KeyError": "Required configuration key missing",
    "AttributeError": "Invalid attribute access",
    "ConnectionError": "Network connection failed",
    "TimeoutError": "Operation timed out",
}
FRIENDLY_DEFAULT = "An error occurred"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it.

    Spark inlines an aliased expression into every place a pushed-down filter needs it; a
    lambda variable keeps it a value.
    """
    return F.transform(F.array(value), use)[0]


def statement_hash(text: Column) -> Column:
    """Short identity of a statement: the first 12 hex characters of its SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def strip_comments(text: Column) -> Column:
    """Line comments, then trailing blanks, then block comments, then outer blanks."""
    text = F.regexp_replace(text, r"--[^\n]*", "")
    text = F.regexp_replace(text, r"(?m)[ \t]+$", "")
    text = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def injection_hits(text: Column) -> Column:
    """The patterns that occur in the text, as an array of pattern strings."""
    return bound(text, lambda t: F.array_compact(F.array(*[
        F.when(t.rlike(p), F.lit(p)) for p in INJECTION_PATTERNS
    ])))


def injection_severity(hits: Column) -> Column:
    critical = F.array(*[F.lit(p) for p in CRITICAL_PATTERNS])
    return (
        F.when(F.arrays_overlap(hits, critical), "critical")
        .when(F.size(hits) >= 3, "warning")
        .otherwise("info")
    )


def shorten(text: Column, limit: int) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(text)


def block_injections(text: Column, limit: int | None = None) -> Column:
    """Replace each pattern in turn, escape backslash and quote, squeeze blank lines, cut."""
    for pattern in INJECTION_PATTERNS:
        text = F.regexp_replace(text, pattern, "[BLOCKED]")
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit('"'), F.lit('\\"'))
    text = F.regexp_replace(text, r"\n\n+", "\n\n")
    return text if limit is None else shorten(text, limit)


def block_context(context: Column, limit: int = 500) -> Column:
    """Clean every string of a map<string, array<string>> context."""
    return F.transform_values(
        context, lambda _, items: F.transform(items, lambda s: block_injections(s, limit))
    )


def scrub_error(message: Column, error_type: Column, include_type: bool = True) -> Column:
    """Hide paths, code places, module names and keys; put a friendly sentence first."""
    clean = message
    for pattern, replacement in ERROR_SCRUBS:
        clean = F.regexp_replace(clean, pattern, replacement)
    friendly = F.create_map(*[F.lit(x) for kv in FRIENDLY_ERRORS.items() for x in kv])
    base = F.coalesce(F.element_at(friendly, error_type), F.lit(FRIENDLY_DEFAULT))
    body = F.when(
        (F.length(clean) > 0) & (clean != error_type), F.concat(base, F.lit(": "), clean)
    ).otherwise(base)
    return F.concat(error_type, F.lit(": "), body) if include_type else body
