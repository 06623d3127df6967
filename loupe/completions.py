"""Completion scripts for shells, from the options of the command line."""

from __future__ import annotations

import argparse

SHELLS = ("bash", "elvish", "fish", "powershell", "zsh")


def _options(parser: argparse.ArgumentParser) -> list[tuple[list[str], str, list[str]]]:
    """(names, help, values) of every option."""
    return [
        (list(a.option_strings), (a.help or "").replace("'", ""), [str(c) for c in a.choices or ()])
        for a in parser._actions
        if a.option_strings
    ]


def script(parser: argparse.ArgumentParser, shell: str) -> str:
    name, options = parser.prog, _options(parser)
    every = " ".join(n for names, _, _ in options for n in names)
    if shell == "bash":
        cases = "\n".join(
            f"        {'|'.join(names)}) COMPREPLY=($(compgen -W '{' '.join(values)}' -- \"$word\")); return;;"
            for names, _, values in options
            if values
        )
        return f"""_{name}() {{
    local word=${{COMP_WORDS[COMP_CWORD]}} before=${{COMP_WORDS[COMP_CWORD-1]}}
    case $before in
{cases}
    esac
    COMPREPLY=($(compgen -W '{every}' -- "$word"))
}}
complete -o default -F _{name} {name}"""
    if shell == "zsh":
        lines = []
        for names, text, values in options:
            value = f":value:({' '.join(values)})" if values else ""
            lines += [f"  '{n}[{text or n}]{value}'" for n in names]
        return f"#compdef {name}\n_arguments \\\n" + " \\\n".join(lines) + " \\\n  '*::file:_files'"
    if shell == "fish":
        lines = []
        for names, text, values in options:
            flags = " ".join(f"-l {n[2:]}" if n.startswith("--") else f"-s {n[1:]}" for n in names)
            lines.append(f"complete -c {name} {flags} -d '{text}'" + (f" -x -a '{' '.join(values)}'" if values else ""))
        return "\n".join(lines)
    words = "\n".join(f"        '{n}'" for names, _, _ in options for n in names)
    if shell == "powershell":
        return f"""Register-ArgumentCompleter -Native -CommandName {name} -ScriptBlock {{
    param($word)
    @(
{words}
    ) | Where-Object {{ $_ -like "$word*" }}
}}"""
    return f"""set edit:completion:arg-completer[{name}] = {{|@words|
    put [
{words}
    ]...
}}"""
