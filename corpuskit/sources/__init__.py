"""Sources: JSONL corpora, run logs, edge lists, literal suites."""

from corpuskit.sources.jsonl import (  # noqa: F401
    decode_ignore, read_json_table, read_jsonl_lines,
)
from corpuskit.sources.runlog import read_run_log  # noqa: F401
from corpuskit.sources.edges import read_edges  # noqa: F401
from corpuskit.sources.suites import prompt_suite, template_set  # noqa: F401
