"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Full-width forms and the ASCII characters they stand for.
WIDE = "０１２３４５６７８９．，：／－＋　ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ"
NARROW = "0123456789.,:/-+ ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Every kind of blank: ASCII white space, no-break space, ideographic space, zero-width characters and the byte-order mark.
BLANK = r"[\s\x{00a0}\x{3000}\x{2000}-\x{200b}\x{feff}]"


def narrow(text: Column) -> Column:
    """Full-width digits, letters and signs as ASCII."""
    return F.translate(text, WIDE, NARROW)


def strip(text: Column) -> Column:
    """Without blanks of any kind at either end. A run of blanks is tried once, so that long ones take linear time."""
    return F.regexp_replace(text, f"^{BLANK}++|(?<!{BLANK}){BLANK}++$", "")


def squeeze(text: Column) -> Column:
    """Inner runs of blanks as one space, none at the ends; empty becomes null."""
    return F.nullif(F.trim(F.regexp_replace(text, f"{BLANK}+", " ")), F.lit(""))


def keep_filled(frame: DataFrame, column: str) -> DataFrame:
    """Rows whose column is not null. A filter would be pushed below the column and compute it twice; a generator isn't."""
    return frame.withColumn(column, F.explode(F.array_compact(F.array(column))))
