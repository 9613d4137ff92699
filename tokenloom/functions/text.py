"""Column expressions that bring loosely written identifiers and labels to one form."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, with the invisible marks that survive copying.
BLANK = r"[\s\p{Z}\p{Cf}\x00-\x20]"


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space and invisible marks."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def blank_to_null(c: Column) -> Column:
    """Stripped; null where nothing is left."""
    s = strip(c)
    return F.when(s != "", s)


def message_key(c: Column) -> Column:
    """The identifier of a message however it is written: white space, case and the
    `tool:` or `tool:v1:` prefix of exports don't count. Null and blank give null."""
    bare = F.regexp_replace(F.lower(strip(c)), r"^(?:claude|codex):(?:v\d+:)?", "")
    return F.when(bare != "", bare)


def project_path(c: Column) -> Column:
    """A project path without surrounding white space and trailing separators; null where
    nothing is left."""
    p = F.regexp_replace(strip(c), r"[\s/\\]+$", "")
    return F.when(p != "", p)
