"""Lines and words of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed set of line ends.
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85  ]"
#: Those that a plain \n isn't.
OTHER_END = "[\x0b\x0c\r\x1c\x1d\x1e\x85  ]"


def lines_of(text: Column) -> Column:
    """The lines of a text; a line end at its end starts no further line, and an empty text has none."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def stripped(line: Column) -> Column:
    """line without the spaces around it; most lines begin and end with a visible ASCII sign and stay as they are."""
    return F.when(line.rlike(r"(?s)^[!-~](.*[!-~])?\z"), line).otherwise(F.regexp_replace(line, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
