"""Shell context: arguments of package managers, the command word of a line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspan.functions.regex import hits

# Package managers, their verbs, commands whose arguments are files.
PACKAGE_TOOLS = (
    r"apt(?:-get)?|aptitude|dnf|yum|microdnf|zypper|apk|pacman|yay|paru|brew|port|snap|flatpak|"
    r"pip3?|pipx|uv\s{1,8}pip|conda|mamba|npm|pnpm|yarn|bun|gem|cargo|choco|winget|scoop|"
    r"nix-env|dpkg|rpm|opkg|pkg|emerge|Install-Package|Install-Module"
)
PACKAGE_VERBS = (
    r"install|add|reinstall|remove|purge|erase|uninstall|upgrade|update|show|info|search|download|"
    r"-S|-Sy|-Syu|-R|-i|-U|-e"
)
FILE_COMMANDS = tuple("""
sh bash zsh ksh dash fish source . cat less more head tail vi vim nvim nano emacs code
cd ls ll dir cp mv rm rmdir mkdir touch chmod chown chgrp ln stat file find tree du
python python3 py node deno ruby perl php java go make cmake tar zip unzip gzip gunzip
diff git grep rg sed awk sort wc xdg-open open start notepad type copy move del
""".split())

_COMMAND = (
    r"^[ \t]*(?:[$#>][ \t]*)?(?:(?:sudo|doas|env|RUN)(?:[ \t]+-\S+){0,8}[ \t]+){0,4}(?:" + PACKAGE_TOOLS + ")"
    r"(?:[ \t]+-{1,2}[\w-]+(?:=\S+)?){0,16}[ \t]+(?:" + PACKAGE_VERBS + r")(?=[ \t]|\\?$)"
)
_ARGUMENTS = r"(?:[^&;|\n]++|&(?!&)|(?<=\\)\n){0,400}+"


def package_spans(text: Column) -> Column:
    """ARRAY<STRUCT<start, end>> of package manager arguments, continuation lines included."""
    found = hits(text, "(?imd)" + _COMMAND + _ARGUMENTS)
    return F.transform(found, lambda h: F.struct(
        (h["start"] + F.length(F.regexp_extract(h["text"], "(?imd)" + _COMMAND, 0))).cast("int").alias("start"),
        (h["start"] + F.length(h["text"])).cast("int").alias("end")))


def in_spans(pos: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] <= pos) & (pos < s["end"]))


def line_prefix(text: Column, pos: Column) -> Column:
    return F.substring_index(F.substring(text, F.lit(1), pos), "\n", -1)


def first_word(prefix: Column) -> Column:
    """The command of a line (behind sudo and prompts); ``./`` for a path."""
    word = F.regexp_extract(prefix, r"(?U)^\s*(?:(?:sudo|doas|\S*[$#>])(?:\s+|$)){0,32}(\S*)", 1)
    return F.when(F.regexp_like(word, F.lit(r"^\.?/")), "./").otherwise(
        F.lower(F.substring_index(word, "/", -1)))
