"""A PySpark-native web content-extraction engine."""

from webextract.operators.conversation import render_conversations
from webextract.operators.elements import process_pages
from webextract.operators.markdown import to_markdown
from webextract.operators.nodes import parse_nodes
from webextract.operators.routing import route, route_column
from webextract.options import Options, merge_options
from webextract.plans.extract import clear_extractors, extract, extract_page, register_extractor, registered_extractors, summary, to_contract_json

__all__ = ["Options", "clear_extractors", "extract", "extract_page", "merge_options", "parse_nodes", "process_pages", "register_extractor", "registered_extractors", "render_conversations", "route", "route_column", "summary", "to_contract_json", "to_markdown"]
