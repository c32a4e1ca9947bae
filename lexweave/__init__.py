"""lexweave: a PySpark-native engine for legal citations.

Documents go in as DataFrames; citations, links, annotated texts and a citator
come out as DataFrames.
"""

from .operators.remote import Remote
from .operators.resolve import Settings, match_cases, match_works, search_cases, search_works
from .operators.verify import check_cases, check_works
from .plans.pipeline import Resolved, annotate, cited_by, cited_cases, cited_works, document_stats, index, learned, resolve, to_json
from .sources.documents import of_text, read_file, read_folder, read_paths, read_table
from .sources.registry import Registers, read_cases, read_works

__all__ = [
    "Registers", "Remote", "Resolved", "Settings", "annotate", "check_cases", "check_works", "cited_by", "cited_cases", "cited_works", "document_stats", "index", "learned", "match_cases", "match_works", "of_text",
    "read_cases", "read_file", "read_folder", "read_paths", "read_table", "read_works", "resolve", "search_cases", "search_works", "to_json",
]
