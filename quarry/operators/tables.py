"""Chunkers for Markdown with pipe tables: whole tables, study plans and module handbooks."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import DataFrame

from quarry.functions import text as T
from quarry.operators.chunk import sequential

#: Fixed value: the legend put before a whole table.
LEGEND = (
    "**Abkürzungen im Studienverlaufsplan:**\n"
    "* Modulprüfung = MP\n"
    "* Studienleistung = SL\n"
    "* ECTS-Leistungspunkte = LP\n"
    "* Semesterwochenstunden = SWS\n"
    "* Profilbildungsbereich = PBB\n"
    "* Prüfungsnummer = Pnr.\n"
)
#: How modules and their courses are marked, and what table separators, bold rows and remarks look like.
MODULE = "### Modul:"
COURSES = "**Lehrveranstaltungen und Lehrformen:**"
_SEPARATOR = re.compile(r"^\|\s*:?-+:?\s*\|")
_BOLD_ROW = re.compile(r"^\|\s*\*\*")
_ITALIC = re.compile(r"^\*[^*].*[^*]\*$")


def whole_tables(text: str, compat: bool = True) -> list[str]:
    """Lines as chunks, each table with the two lines above it in one chunk behind the legend.

    ``compat`` keeps the established quirks: the first line only shows as a table's context, the first
    chunk may be empty, a table one line below another swallows that table, and a table in the
    first lines is an error. Otherwise no table is lost and empty chunks are left out.
    """
    rows = [s for x in text.split("\n") if (s := x.strip())]
    done: list[str] = []
    held, table = "", False
    for n in range(1, len(rows)):
        row = rows[n]
        if row.startswith("|") and not table:
            # the line just held becomes context together with the one already emitted before it
            if done and (compat or not done[-1].startswith(LEGEND)):
                done.pop()
            elif compat:
                raise IndexError("a table needs two lines with a chunk of their own above it")
            held, table = "\n".join((rows[n - 2] if n > 1 or compat else "", rows[n - 1], row)).lstrip("\n"), True
        elif row.startswith("|") or row.startswith("**"):
            held += "\n" + row
        else:
            done.append((LEGEND if table else "") + held)
            held, table = row, False
    if len(rows) > 1:
        done.append((LEGEND if table else "") + held)
    return done if compat else [d for d in done if d]


def study_plan(text: str) -> list[str]:
    """Sentences of the prose, and each table cut before rows that begin in bold, under its ``###`` title."""
    out, title = [], ""
    for table, run in groupby(map(str.strip, text.splitlines()), key=lambda x: x.startswith("|")):
        if not table:
            for line in filter(None, run):
                if line.startswith("### "):
                    title = line
                elif not _ITALIC.match(line):
                    out += T.split_sentences(line)
            continue
        parts: list[list[str]] = []
        for row in list(run)[1:]:
            if _SEPARATOR.match(row):
                continue
            if not parts or _BOLD_ROW.match(row):
                parts.append([])
            parts[-1].append(row)
        lead = f"{title}\n\n" if title else ""
        out += [lead + T.expand("\n".join(p)) for p in parts]
        title = ""
    return out


def module_handbook(text: str) -> list[str]:
    """Fields of each module under its title, course letters replaced by names; other lines by sentence."""
    out, title, names = [], "", {}
    for line in filter(str.strip, text.splitlines()):
        line = line.strip()
        if line.startswith(MODULE):
            title, names = line, {}
        elif line.startswith(("## ", "# ")):
            title, names = "", {}
        elif title and line.startswith("**"):
            if line.startswith(COURSES):
                names = T.courses(line)
            out.append(f"{title}\n{T.name_courses(line, names)}")
        else:
            out += T.split_sentences(line)
    return out


def by_whole_tables(docs: DataFrame, compat: bool = True) -> DataFrame:
    return sequential(docs, "whole_table", lambda _, t: [(i, c, {}) for i, c in enumerate(whole_tables(t, compat))])


def by_split_tables(docs: DataFrame) -> DataFrame:
    """Handbooks are told by a ``### Modul:`` line. Numbers count blank chunks, which are left out."""

    def cut(_, t):
        parts = module_handbook(t) if re.search(rf"^{MODULE}", t, re.MULTILINE) else study_plan(t)
        return [(i, c, {}) for i, c in enumerate(parts) if c.strip()]

    return sequential(docs, "split_table_paragraph", cut)
