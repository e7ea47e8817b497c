"""Text cleaning: Unicode-aware strip, header resolution, report text sanitiser.

Spark's ``trim`` only removes U+0020 and Java's ``\\s`` misses NBSP (U+00A0)
and NNBSP (U+202F), the French thousands separators.  The ``(?U)`` flag
switches Java regex classes to Unicode semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java regex pattern (as seen by the engine)
NON_LATIN1 = r"[^\x00-\xFF]"
# The Unicode White_Space set (what (?U)\s matches), as plain
# characters so strip/removal run as btrim/translate instead of regex
WS_CHARS = ("\t\n\u000b\f\r \u0085\u00a0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")


def ustrip(c: Column | str) -> Column:
    """Unicode strip (leading/trailing whitespace incl. NBSP)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(WS_CHARS))


def remove_ws(c: Column) -> Column:
    """Delete every Unicode whitespace character."""
    return F.translate(c, WS_CHARS, "")


def clean_branch(c: Column | str) -> Column:
    """OP-F6: cast to string and strip."""
    c = F.col(c) if isinstance(c, str) else c
    return ustrip(c.cast("string"))


def clean_year(c: Column | str) -> Column:
    """OP-F7: cast to string, remove a trailing '.0', strip."""
    c = F.col(c) if isinstance(c, str) else c
    return ustrip(F.regexp_replace(c.cast("string"), r"\.0$", ""))


# ---------------------------------------------------------------------------
# Header resolution (schema metadata, evaluated once per file layout)
# ---------------------------------------------------------------------------
# Accent folding of header names and the claims header contract:
# canonical name, label, names that match whole, parts that match inside
HEADER_FOLD = {"û": "u", "é": "e", "è": "e", "ê": "e"}
CLAIMS_CONTRACT = [
    ("Branche", "BRANCHE", ["branche"], []),
    ("Total_Reglement", "REGLEMENT", ["reglement", "règlement"], ["reglement", "règlement"]),
    ("Cout_Total", "COUT_TOTAL", ["cout_total", "cout total", "coût_total", "coût total"], ["couttotal", "coutotal"]),
]
_FOLD = str.maketrans(HEADER_FOLD)


class HeaderError(ValueError):
    """A file's headers miss part of the contract: ``missing`` labels, ``found``
    (canonical name, header) pairs and the ``available`` headers."""

    def __init__(self, missing: list[str], found: list[tuple[str, str]], available: list[str]):
        self.missing, self.found, self.available = missing, found, available
        hits = ", ".join(f"{canonical.split('_')[-1]}='{header}'" for canonical, header in found)
        super().__init__(f"Colonnes manquantes: {', '.join(missing)}. Colonnes trouvées: {hits or 'aucune'}. "
                         f"Colonnes disponibles: {', '.join(available)}")


def normalize_header(name: str) -> str:
    """OP-F1: lower case, four accents folded, runs of white space as one space, none at the ends."""
    return " ".join(name.lower().translate(_FOLD).split())


def header_rank(header: str, whole: list[str], parts: list[str]) -> int | None:
    """How well a header fits: 0 as a whole name, 1 by containing a part once spaces are gone, None not at all."""
    key = normalize_header(header)
    if key in whole:
        return 0
    return 1 if any(part in key.replace(" ", "") for part in parts) else None


def best_header(columns: list[str], whole: list[str], parts: list[str] | None = None) -> str | None:
    """OP-F2: the best-fitting header, the first in file order among equals."""
    ranked = [(rank, at) for at, c in enumerate(columns) if (rank := header_rank(c, whole, parts or [])) is not None]
    return columns[min(ranked)[1]] if ranked else None


def resolve_claims_columns(columns: list[str]) -> dict[str, str]:
    """OP-F3 schema step: the file's header for each canonical name, or a ``HeaderError``."""
    best = {canonical: best_header(columns, whole, parts) for canonical, _, whole, parts in CLAIMS_CONTRACT}
    missing = [label for canonical, label, _, _ in CLAIMS_CONTRACT if best[canonical] is None]
    if missing:
        raise HeaderError(missing, [(k, v) for k, v in best.items() if v is not None], list(columns))
    return best


# ---------------------------------------------------------------------------
# Report text sanitiser (OP-F22)
# ---------------------------------------------------------------------------
# Report text replacements, in their natural order
SANITIZE_REPLACEMENTS = [
    ("\u2014", "-"),    # em dash
    ("\u2013", "-"),    # en dash
    ("\u2018", "'"),    # left single quote
    ("\u2019", "'"),    # right single quote
    ("\u201c", '"'),    # left double quote
    ("\u201d", '"'),    # right double quote
    ("\u2026", "..."),  # ellipsis
    ("\u2022", "-"),    # bullet
    ("\u00b7", "-"),    # middle dot
    ("\u2265", ">="),   # greater or equal
    ("\u2264", "<="),   # less or equal
    ("\u00d7", "x"),    # multiplication sign
    ("\u2192", "->"),   # right arrow
    ("\u00e9", "e"),
    ("\u00e8", "e"),
    ("\u00ea", "e"),
    ("\u00e0", "a"),
    ("\u00f4", "o"),
    ("\u00e7", "c"),
    ("\u00fb", "u"),
    ("\u00ee", "i"),
]
# single characters go through one translate, longer replacements through replace
SANITIZE_ONE_TO_ONE = [(a, b) for a, b in SANITIZE_REPLACEMENTS if len(b) == 1]
SANITIZE_ONE_TO_MANY = [(a, b) for a, b in SANITIZE_REPLACEMENTS if len(b) != 1]


def sanitize_text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    src = "".join(a for a, _ in SANITIZE_ONE_TO_ONE)
    dst = "".join(b for _, b in SANITIZE_ONE_TO_ONE)
    out = F.translate(c, src, dst)
    for a, b in SANITIZE_ONE_TO_MANY:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, NON_LATIN1, "?")
