"""Query of the repeated-string removal."""

from .common import table
from .registry import register
from .suffix import removal_report

LENGTH = 400


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark, sf_dir):
    return removal_report(table(spark, sf_dir, "documents"), length=LENGTH)
