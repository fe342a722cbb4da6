"""The functions that SQL text can call: scalars as SQL functions, which stay in generated code, and a table function for captions."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from chronoframe.functions.scalar import SPACE
from chronoframe.operators.captions import CUE

_STRIP = rf"regexp_replace({{0}}, r'^{SPACE}+|{SPACE}+$', '')"
#: Name, arguments, result and body.
SCALARS = {
    "parse_time": ("t STRING", "DOUBLE", f"""CASE WHEN {_STRIP.format('t')} = '' THEN NULL ELSE CASE size(split({_STRIP.format('t')}, ':'))
WHEN 1 THEN try_cast({_STRIP.format('t')} AS DOUBLE)
WHEN 2 THEN CAST(try_cast(split_part({_STRIP.format('t')}, ':', 1) AS BIGINT) AS DOUBLE) * 60 + try_cast(split_part({_STRIP.format('t')}, ':', 2) AS DOUBLE)
WHEN 3 THEN CAST(try_cast(split_part({_STRIP.format('t')}, ':', 1) AS BIGINT) AS DOUBLE) * 3600 + CAST(try_cast(split_part({_STRIP.format('t')}, ':', 2) AS BIGINT) AS DOUBLE) * 60 + try_cast(split_part({_STRIP.format('t')}, ':', 3) AS DOUBLE) END END"""),
    "format_time": ("s DOUBLE", "STRING", "CASE WHEN floor(rint(s) / 3600) <> 0 THEN format_string('%d:%02d:%02d', CAST(floor(rint(s) / 3600) AS BIGINT), pmod(CAST(rint(s) AS BIGINT), 3600) div 60, pmod(CAST(rint(s) AS BIGINT), 60)) WHEN s IS NOT NULL THEN format_string('%02d:%02d', CAST(rint(s) AS BIGINT) div 60, CAST(rint(s) AS BIGINT) % 60) END"),
    "is_significant": ("t STRING", "BOOLEAN", "length(replace(coalesce(t, ''), ' ', '')) >= 10"),
    "is_url": ("u STRING", "BOOLEAN", "coalesce(u RLIKE r'(?i)^https?://[^/?#]+', false)"),
}
_CUE, _TAG = re.compile(CUE), re.compile("<[^>]+>")


def _seconds(h: str, m: str, s: str, ms: str) -> float:
    return round(((int(h) * 60 + int(m)) * 60 + int(s)) + int(ms) / 1000, 2)


@udtf(returnType="seq long, start double, `end` double, text string")
class ParseVtt:
    """The cues of one WebVTT text, rolling lines collapsed, as captions.parse_vtt gives them: for lateral joins. A null text has none."""

    def eval(self, text: str) -> Iterator[tuple[int, float, float, str]]:
        block: list[str] = []
        run: list | None = None
        cue: tuple | None = None
        for n, line in enumerate([*(text or "").splitlines(), ""]):
            if not line.strip():
                said = " ".join(block)
                if cue and said:
                    seq, start, end = cue
                    if run and (said == run[3] or said.startswith(run[3] + " ")):
                        run[2:] = [end, said]
                    else:
                        if run:
                            yield tuple(run)
                        run = [seq, start, end, said]
                block, cue = [], None
            elif cue:
                block += [x] if (x := _TAG.sub("", line).strip()) else []
            elif found := _CUE.match(line):
                cue = n, _seconds(*found.groups()[:4]), _seconds(*found.groups()[4:])
        if run:
            yield tuple(run)


def register(spark: SparkSession) -> None:
    """For this session: parse_time, format_time, is_significant, is_url, and the table function parse_vtt."""
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udtf.register("parse_vtt", ParseVtt)
