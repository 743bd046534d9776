"""Corrections that rules propose, accepted and applied to the files.

One pass finds and one applies: there is no second round over corrected text. Rules
over whole files report beside the others. Null contents count as empty. A path
must not repeat (see analysis.one_of_each_path). No files or no edits give no rows
or unchanged files.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators import file_rules as whole
from sleuthframe.operators.corrections import NO_EDITS, applied
from sleuthframe.operators.eligibility import with_skips
from sleuthframe.operators.line_rules import DIAGNOSTICS
from sleuthframe.parser.nodes import shared_nodes
from sleuthframe.rules.engine import SUPPRESSED, NodeRule, asked_of, node_findings

#: The edits of all findings that say how to correct what they report, whole.
EDITS = f"""flatten(transform(found, (f, i) -> if(f.edits IS NOT NULL AND forall(f.edits, e -> e.start IS NOT NULL AND e.end IS NOT NULL AND e.text IS NOT NULL),
    transform(f.edits, e -> named_struct('correction_id', cast(i + 1 AS bigint), 'start', cast(e.start AS bigint), 'end', cast(e.end AS bigint), 'replacement', e.text, 'indirect', coalesce(f.indirect, false))), {NO_EDITS})))"""


def autocorrect(files: DataFrame, rules: Iterable[NodeRule], directives: bool = True, config: Mapping | None = None, file_rules: Iterable = ()) -> tuple[DataFrame, DataFrame]:
    """(diagnostics with a column `corrected`, files(path, content, accepted,
    subsumed) after the accepted edits)."""
    rules, file_rules = tuple(rules), tuple(file_rules)
    files = files.select("path", F.coalesce("content", F.lit("")).alias("content"))
    looked = with_skips(files, [r.name for r in (*rules, *file_rules)], config)
    looked = looked.withColumn("told", whole.findings_in(file_rules)) if file_rules else looked
    found = node_findings(shared_nodes(looked, asked_of(rules, corrects=True)), rules, corrects=True, config=config)
    if directives:
        found = found.filter(~F.expr(SUPPRESSED.format(line="at.line")))
    # a file's findings meet in one row, in order of place; where only the texts are asked for, with what edits take
    place = [F.col("at.start").alias("begin"), F.col("at.end").alias("stop"), "rule", "message"]

    def met(*columns: str) -> DataFrame:
        listed = found.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*place, *columns))).alias("found"))
        # findings of null paths meet no file
        return files.join(listed, "path", "full").withColumn("edits", F.expr(EDITS))

    after = applied(met("indirect", "edits").filter("content IS NOT NULL").drop("found"))
    rows = met("severity", "correctable", "indirect", "edits", "at")
    told = applied(rows.filter("found IS NOT NULL")).select("path", "done", F.posexplode("found").alias("i", "f")).select("path", "f.*", F.coalesce(F.expr("get(done, i)"), F.lit(False)).alias("corrected"))
    told = told.select("path", "at.line", "at.column", "at.last_line", "at.last_column", F.greatest(F.lit(1), F.col("stop") - F.col("begin")).alias("length"), "rule", "severity", "message", "correctable", "corrected")
    return told.select(*DIAGNOSTICS, "corrected"), after
