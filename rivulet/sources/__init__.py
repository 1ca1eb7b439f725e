from rivulet.sources.delimited import delimited
from rivulet.sources.registry import Sources
from rivulet.sources.schema_text import Table, parse_schema

__all__ = ["Sources", "Table", "delimited", "parse_schema"]
