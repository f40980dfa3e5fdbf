"""Rule-based extraction of entities and relations, as column expressions.

Six rules look at a text; what every matching rule finds is put together in the order of the rules. ``extracted`` gives one
struct column of entities and relations; ``entities_of`` and ``relations_of`` make rows of it. Nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as tx

# The patterns of the rules.
ERROR = r"(?i)(?:command not found|permission denied|no such file|exit code \d+|error:|fatal:|ERRO(?:R)?\[|panic:|segmentation fault|killed|cannot|failed to)"
COMMIT = r"(?m)^commit [0-9a-f]{7,40}"
DIFF = r"(?m)^diff --git a/(.+?) b/(.+)"
AUTHOR = r"(?m)^Author:\s+(.+?)\s*<"
MESSAGE = r"(?m)^    (.+)"
CONFIG_FILE = r"(?i)(?:\.json|\.ya?ml|\.toml|\.env|\.ini|\.conf|\.cfg)\b"
CONFIG_VERB = r"(?i)\b(?:set|changed|updated|configured|modified|added|removed|enabled|disabled)\b"
MANIFEST = r"(?i)(?:go\.mod|go\.sum|package\.json|requirements\.txt|Pipfile|Cargo\.toml|Gemfile|pom\.xml|build\.gradle)\b"
INSTALL = r"(?i)\b(?:go get|go install|npm install|pip install|cargo add|gem install|yarn add|pnpm add)\s+(\S+)"
DECISION = r"(?i)\b(?:decided to|chose|went with|switched (?:from|to)|picked|selected|opted for)\b"
PREFERENCE = r"(?i)\b(?:(?:I |we |always |never |prefer|don't use|avoid|stop using)\b)"
ERROR_PREFIXES = ("error:", "fatal:", "Error:", "Fatal:", "ERROR:", "FATAL:")
NAME_LENGTH, SUMMARY_LENGTH = 80, 200
FAILED_WEIGHT, MODIFIED_WEIGHT, DEPENDS_WEIGHT = 0.8, 0.7, 0.7

ENTITY = "struct<name:string,type:string,summary:string>"
RELATION = "struct<source:string,target:string,type:string,summary:string,weight:double>"


def _entity(name: Column, kind: str, summary: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), summary.alias("summary"))


def _relation(source: Column, target: Column, kind: str, summary: Column, weight: float) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), summary.alias("summary"), F.lit(weight).alias("weight"))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _first(values: Column) -> Column:
    return F.try_element_at(values, F.lit(1))


def _one(value: Column, kind: str) -> Column:
    """A list of a struct, empty where it is null."""
    return F.when(value.isNotNull(), F.array(value)).otherwise(_none(kind))


def error_name(line: Column) -> Column:
    """What follows the first of the prefixes that has something behind it; else the line."""
    name = line
    for prefix in reversed(ERROR_PREFIXES):
        rest = tx.collapse_ends(F.substring(line, F.locate(prefix, line) + len(prefix), F.length(line)))
        name = F.when((F.locate(prefix, line) > 0) & (rest != ""), rest).otherwise(name)
    return F.substring(name, 1, NAME_LENGTH)


def command_name(text: Column) -> Column:
    """The first word after a prompt at the start of a line; null for none."""
    lines = F.transform(F.split(text, "\n"), tx.collapse_ends)
    return _first(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^[$>] \s*(\S+)", 1)), lambda x: x != ""))


def _errors(text: Column) -> tuple[Column, Column]:
    lines = F.transform(F.split(text, "\n"), tx.collapse_ends)
    line = F.substring(_first(F.filter(lines, lambda x: (x != "") & x.rlike(ERROR))), 1, SUMMARY_LENGTH)
    name, command = error_name(line), F.when(line.isNotNull(), command_name(text))
    entities = F.concat(_one(F.when(line.isNotNull(), _entity(name, "event", line)), ENTITY), _one(F.when(command.isNotNull(), _entity(command, "tool", F.lit("command that produced an error"))), ENTITY))
    return entities, _one(F.when(command.isNotNull(), _relation(command, name, "failed_with", line, FAILED_WEIGHT)), RELATION)


def _commits(text: Column) -> tuple[Column, Column]:
    matched = text.rlike(COMMIT) | text.rlike(DIFF)
    files = F.array_sort(F.array_distinct(_all(text, DIFF, 2)))
    author = F.when(text.rlike(AUTHOR), tx.collapse_ends(F.regexp_extract(text, AUTHOR, 1)))
    messages = F.transform(F.slice(_all(text, MESSAGE, 1), 1, 5), tx.collapse_ends)
    message = _first(F.filter(messages, lambda m: (m != "") & ~m.startswith("Merge")))
    short = F.substring(message, 1, NAME_LENGTH)
    entities = F.concat(
        _one(F.when(author.isNotNull(), _entity(author, "person", F.lit("git commit author"))), ENTITY),
        _one(F.when(message.isNotNull(), _entity(short, "event", F.concat(F.lit("git commit: "), message))), ENTITY),
        F.transform(files, lambda f: _entity(f, "concept", F.lit("source file modified in commit"))),
    )
    relations = F.when(message.isNotNull(), F.transform(files, lambda f: _relation(short, f, "modified", F.lit("commit modified this file"), MODIFIED_WEIGHT))).otherwise(_none(RELATION))
    return F.when(matched, entities).otherwise(_none(ENTITY)), F.when(matched, relations).otherwise(_none(RELATION))


def _configs(text: Column) -> tuple[Column, Column]:
    matched = text.rlike(CONFIG_FILE) & text.rlike(CONFIG_VERB)
    files = F.array_sort(F.array_distinct(F.slice(_all(text, CONFIG_FILE), 1, 5)))
    verb = F.lower(_first(_all(text, CONFIG_VERB)))
    changed = _entity(F.lit("config change"), "event", F.substring(tx.collapse_ends(text), 1, SUMMARY_LENGTH))
    entities = F.concat(F.transform(files, lambda f: _entity(f, "concept", F.concat(F.lit("configuration file that was "), verb))), F.array(changed))
    return F.when(matched, entities).otherwise(_none(ENTITY)), _none(RELATION)


def _dependencies(text: Column) -> tuple[Column, Column]:
    packages = F.slice(_all(text, INSTALL, 1), 1, 10)
    entities = F.transform(packages, lambda p: _entity(p, "tool", F.lit("dependency package")))
    return entities, F.transform(packages, lambda p: _relation(F.lit("project"), p, "depends_on", F.lit("project depends on this package"), DEPENDS_WEIGHT))


def _sentence(text: Column, pattern: str, label: str) -> tuple[Column, Column]:
    # A sentence's match needs the text's: the split is not made for most texts.
    said = F.substring(_first(F.filter(tx.split_sentences(text), lambda s: s.rlike(pattern))), 1, SUMMARY_LENGTH)
    entity = F.when(said.isNotNull(), _entity(F.substring(said, 1, NAME_LENGTH), "concept", F.concat(F.lit(f"{label}: "), said)))
    return F.when(text.rlike(pattern), _one(entity, ENTITY)).otherwise(_none(ENTITY)), _none(RELATION)


def matches(text: Column) -> Column:
    """Whether any rule looks at the text."""
    either = text.rlike(ERROR) | text.rlike(COMMIT) | text.rlike(DIFF) | (text.rlike(CONFIG_FILE) & text.rlike(CONFIG_VERB))
    return either | text.rlike(MANIFEST) | text.rlike(INSTALL) | text.rlike(DECISION) | text.rlike(PREFERENCE)


def extracted(text: Column) -> Column:
    """struct(entities, relations); empty lists for null."""
    text = F.coalesce(text, F.lit(""))
    found = [_errors(text), _commits(text), _configs(text), _dependencies(text), _sentence(text, DECISION, "decision"), _sentence(text, PREFERENCE, "preference")]
    return F.struct(F.concat(*[e for e, _ in found]).alias("entities"), F.concat(*[r for _, r in found]).alias("relations"))


def entities_of(table: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """(keep..., position, name, type, summary), in the order found."""
    return table.select(*keep, F.posexplode(extracted(F.col(text_col))["entities"]).alias("position", "e")).select(*keep, "position", "e.*")


def relations_of(table: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    return table.select(*keep, F.posexplode(extracted(F.col(text_col))["relations"]).alias("position", "r")).select(*keep, "position", "r.*")
