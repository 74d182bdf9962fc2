"""Dates of partner feeds, with strptime's reading of short years and unpadded numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import SPACE

#: strptime directives and Spark's letters; single letters take padded and unpadded numbers.
LETTERS = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM"}


def spark_format(fmt: str) -> str:
    for k, v in LETTERS.items():
        fmt = fmt.replace(k, v)
    return fmt


def try_date(c: Column, fmt: str, pivot: int = 69) -> Column:
    """One format's date or null. Spark reads yy as 2000 to 2099; years from the pivot on belong to the 1900s."""
    d = F.try_to_date(c, spark_format(fmt))
    return F.when(F.year(d) >= 2000 + pivot, F.add_months(d, -1200)).otherwise(d) if "%y" in fmt else d


def parse_date(c: Column, formats: list[str], pivot: int = 69) -> Column:
    """ISO text of the first format that fits, else null."""
    return F.date_format(F.coalesce(*[try_date(c, f, pivot) for f in formats]), "yyyy-MM-dd")


def date_error(c: Column, formats: list[str], pivot: int = 69) -> Column:
    """Null, `empty`, or `unparseable: tried [...]`."""
    tried = "unparseable: tried " + repr(formats)
    return F.when(F.coalesce(c, F.lit("")) == "", "empty").when(parse_date(c, formats, pivot).isNull(), tried)


def us_date(c: Column, pivot: int = 30) -> Column:
    """M/D/Y to ISO text, short years above the pivot in the 1900s, white space around the numbers ignored; other texts stay.

    A year is short if it is written with two characters after its slash, white space before it included; such a year of one digit
    is none, and the text stays.
    """
    number = rf"{SPACE}*(\d+){SPACE}*"
    part = lambda i: F.regexp_extract(c, rf"(?U)^{number}/{number}/({SPACE}*(\d+)){SPACE}*$", i)
    m, d, written, y = (part(i) for i in (1, 2, 3, 4))
    pad = lambda x, n: F.lpad(x, F.greatest(F.length(x), F.lit(n)), F.lit("0"))
    bare = lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "")
    short = F.length(written) == 2
    year = F.when(short, F.concat(F.when(y.try_cast("int") > pivot, "19").otherwise("20"), y)).otherwise(pad(bare(y), 4))
    return F.when((m != "") & ~(short & (F.length(y) < 2)), F.concat_ws("-", year, pad(bare(m), 2), pad(bare(d), 2))).otherwise(c)
