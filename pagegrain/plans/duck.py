"""SQL fragments for the DuckDB side: what a column means, said again in the other engine's own words."""

from __future__ import annotations


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def bare_host(url: str) -> str:
    return f"regexp_replace({host(url)}, '^www\\.', '')"


def authority(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def scheme(url: str) -> str:
    return f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def path(url: str) -> str:
    return (f"regexp_replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), "
            f"';[^/]*$', '')")


def query(url: str) -> str:
    return f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"


def segments(text: str) -> str:
    return f"list_filter(string_split({text}, '/'), lambda sg: sg <> '')"


def parts(url: str) -> str:
    return f"list_filter(string_split({query(url)}, '&'), lambda qp: qp <> '')"


def keys(url: str) -> str:
    """Lower-case keys of parameters with a value."""
    return (f"list_transform(list_filter({parts(url)}, lambda qv: regexp_extract(qv, '^[^=]*=(.*)$', 1) <> ''), "
            f"lambda qk: lower(url_decode(replace(split_part(qk, '=', 1), '+', ' '))))")


def words(items) -> str:
    return "[" + ", ".join("'" + item.replace("'", "''") + "'" for item in items) + "]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def like(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {text(pattern)})"


def squeeze(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"
