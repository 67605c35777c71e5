"""Query of the licence scan."""

from .common import settle, table
from .licenses import fit_grams, paragraph_grams, scan_grams
from .registry import register


@register("op8_license_scan")
def op8_license_scan(spark, sf_dir):
    """The n-grams of all paragraphs are taken once: the classifier learns from all of them and then reads them again."""
    rows = settle(paragraph_grams(table(spark, sf_dir, "documents")))
    return scan_grams(rows, fit_grams(rows))
