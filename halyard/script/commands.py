"""Statements to commands."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# The command language, in the order in which patterns are tried.
COMMANDS = {
    "QUIT": r"QUIT|EXIT",
    "CLEAR": r"CLEAR",
    "HELP": r"HELP",
    "SHOW_CATALOGS": r"SHOW\s+CATALOGS",
    "SHOW_DATABASES": r"SHOW\s+DATABASES",
    "SHOW_TABLES": r"SHOW\s+TABLES",
    "SHOW_FUNCTIONS": r"SHOW\s+FUNCTIONS",
    "SHOW_MODULES": r"SHOW\s+MODULES",
    "USE_CATALOG": r"USE\s+CATALOG\s+(.*)",
    "USE": r"USE\s+(?!CATALOG)(.*)",
    "DESCRIBE": r"DESCRIBE\s+(.*)",
    "EXPLAIN": r"EXPLAIN\s+(.*)",
    "SELECT": r"(SELECT.*)",
    "INSERT_INTO": r"(INSERT\s+INTO.*)",
    "INSERT_OVERWRITE": r"(INSERT\s+OVERWRITE.*)",
    "BEGIN_STATEMENT_SET": r"(BEGIN\s+STATEMENT\s+SET.*)",
    "END": r"(END)",
    "CREATE_TABLE": r"(CREATE\s+TABLE\s+.*)",
    "DROP_TABLE": r"(DROP\s+TABLE\s+.*)",
    "CREATE_VIEW": r"CREATE\s+VIEW\s+(\S+)\s+AS\s+(.*)",
    "CREATE_DATABASE": r"(CREATE\s+DATABASE\s+.*)",
    "DROP_DATABASE": r"(DROP\s+DATABASE\s+.*)",
    "DROP_VIEW": r"DROP\s+VIEW\s+(.*)",
    "ALTER_DATABASE": r"(ALTER\s+DATABASE\s+.*)",
    "ALTER_TABLE": r"(ALTER\s+TABLE\s+.*)",
    "SET": r"SET(?:\s+(\S+)\s*=(.*))?",
    "RESET": r"RESET",
    "SOURCE": r"SOURCE\s+(.*)",
}
_PATTERNS = {name: re.compile(p, re.I | re.S) for name, p in COMMANDS.items()}


@dataclass(frozen=True)
class Command:
    name: str
    operands: tuple[str, ...] = ()
    sql: str = field(default="", compare=False)


def parse_command(statement: str) -> Command | None:
    """The first command whose pattern the whole statement fits, trimmed and without a last semicolon; None for other text."""
    text = statement.strip()
    if text.endswith(";"):
        text = text[:-1].strip()
    for name, pattern in _PATTERNS.items():
        if m := pattern.fullmatch(text):
            return Command(name, tuple(g for g in m.groups() if g is not None), text)
    return None
