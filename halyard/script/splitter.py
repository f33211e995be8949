"""Scripts to statements."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import SparkSession

#: Cuts a script before anything else is done to it.
MARK = "--split--"


def read_script(path: str, spark: SparkSession | None = None) -> str:
    """A local file, or with a session any path that Spark reads."""
    if spark is None:
        return Path(path).read_text(encoding="utf-8")
    return spark.read.text(path, wholetext=True).first()[0]


def read_properties(text: str) -> dict[str, str]:
    """Lines of key=value or key: value; # and ! begin comments."""
    out = {}
    for line in text.splitlines():
        if (line := line.strip()) and line[0] not in "#!" and (m := re.match(r"([^=:\s]+)\s*[=:]?\s*(.*)", line)):
            out[m[1]] = m[2]
    return out


def load_profile(active: str, folder: str) -> dict[str, str]:
    """The properties of the profile that `active` names: the first of prod, dev and local that it holds, else itself."""
    name = next((p for p in ("prod", "dev", "local") if p in active), active)
    return read_properties((Path(folder) / f"{name}.properties").read_text(encoding="utf-8"))


def split_script(text: str, properties: dict[str, str] | None = None) -> list[str]:
    """Parts between marks lose lines that begin with --, get LF line ends and their ${key}s, and are cut at semicolons before a line end. Blank statements stay out."""
    out = []
    for part in text.split(MARK):
        part = re.sub(r"(?m)^--.*", "", part).replace("\r\n", "\n")
        for key, value in (properties or {}).items():
            part = part.replace(f"${{{key}}}", value)
        out += part.split(";\n")
    return [s for s in out if s.strip()]


def statements_of(text: str) -> list[str]:
    """Statements between semicolons outside quotes and comments."""
    from halyard.script.tokens import tokenize

    out, now = [], []
    for kind, value in tokenize(text):
        if value == ";":
            out.append("".join(now))
            now = []
        elif kind != "comment":
            now.append(value)
    out.append("".join(now))
    return [s.strip() for s in out if s.strip()]
