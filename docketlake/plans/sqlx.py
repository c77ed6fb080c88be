"""DuckDB expressions that the oracle SQL of several queries shares."""

from __future__ import annotations

from ..functions import urls as U


def extract(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, '{quoted(pattern)}', {group})"


def replace(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{quoted(pattern)}', '{quoted(by)}', 'g')"


def quoted(text: str) -> str:
    return text.replace("'", "''")


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{quoted(pattern)}')"


def scheme(u: str) -> str:
    return f"lower({extract(u, U.SCHEME)})"


def netloc(u: str) -> str:
    return f"lower({extract(u, U.AUTHORITY)})"


def path(u: str) -> str:
    return extract(u, U.PATH)


def query(u: str) -> str:
    return extract(u, U.QUERY)


def host(u: str) -> str:
    return f"coalesce({replace(replace(replace(netloc(f'trim({u})'), '^.*@'), ':[0-9]*$'), '^www[.]')}, '')"


def kept_query(u: str, names: str) -> str:
    return f"array_to_string(list_filter(string_split({query(u)}, '&'), lambda x: x <> '' and not regexp_matches(x, '^({names})=')), '&')"


def normalized(u: str, profile: str) -> str:
    how = f"case when {scheme(u)} = '' then 'https' else {scheme(u)} end"
    site = netloc(u)
    if profile == "pipeline":
        site = f"case when {how} = 'https' then {replace(site, ':443$')} else {replace(site, ':80$')} end"
    p = replace(replace(path(u), ";[^/]*$"), "/+", "/")
    kept = kept_query(u, U.TRACKING[profile])
    return f"({how}) || '://' || ({site}) || case when {p} = '' then '/' else {p} end || case when {kept} = '' then '' else '?' || {kept} end"


def initcap(x: str) -> str:
    """Blanks part words, as in Spark."""
    return f"array_to_string(list_transform(string_split(lower({x}), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')"
