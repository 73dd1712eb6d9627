"""Names, versions and URLs: each rule as a Column and, where the control plane needs it, as plain Python."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import VERSION, BindingError
from .hosts import to_ascii, to_ascii_col


def reverse_labels(host: str) -> str:
    return ".".join(reversed(host.rstrip(".").split(".")))


def reverse_labels_col(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(F.regexp_replace(host, r"\.+$", ""), r"\.", -1)), ".")


def short_name(name: str) -> str:
    return name.rpartition(".")[2]


def short_name_col(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def is_url(text: str) -> bool:
    return text.startswith(("http://", "https://"))


def is_url_col(text: Column) -> Column:
    return text.startswith("http://") | text.startswith("https://")


def url_path(url: str) -> str | None:
    """From the first slash after the host, with query and fragment; other text as it is; None if a URL has no path."""
    if not is_url(url):
        return url
    slash = url.find("/", url.index("://") + 3)
    return url[slash:] if slash >= 0 else None


def url_path_col(url: Column) -> Column:
    return F.when(is_url_col(url), F.nullif(F.regexp_extract(url, r"(?s)^https?://[^/]*(/.*)$", 1), F.lit(""))).otherwise(url)


def map_prefix(url: str, local: str, remote: str | None) -> str:
    """The local path of a URL or path: without the remote prefix if it has it, else joined to the local folder."""
    rest = url[len(remote) :] if remote and url.startswith(remote) else url
    return f"{local.rstrip('/')}/{rest.lstrip('/')}"


def map_prefix_col(url: Column, local: str, remote: str | None) -> Column:
    rest = F.when(url.startswith(remote), F.substring(url, len(remote) + 1, 1 << 30)).otherwise(url) if remote else url
    return F.concat(F.lit(local.rstrip("/") + "/"), F.regexp_replace(rest, "^/+", ""))


def join_url(ref: str, base: str) -> str:
    """A reference against the folder of its base; `..` is left alone."""
    if is_url(ref):
        return ref
    return base[: base.rfind("/") + 1] + ref if "/" in base else ref


def join_url_col(ref: Column, base: Column) -> Column:
    return F.when(is_url_col(ref), ref).otherwise(F.concat(F.regexp_extract(base, r"(?s)^(.*/)?", 0), ref))


def is_version_col(version: Column) -> Column:
    return version.rlike(f"^(?:{VERSION.pattern})$") & ~version.contains("\n")


def in_range_col(version: Column, least: Column, most: Column) -> Column:
    """Compared as text; a missing end is open."""
    return (version >= least) & (most.isNull() | (version <= most))


# Namespace authority: a capability belongs under the reversed host of its schema's URL.

#: What no host may hold, once it is percent-decoded.
_FORBIDDEN = r"[\x00-\x20\x7F#/:<>?@\[\\\]^|%]"
_AUTHORITY = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):/*([^/?#\\]*)")


def check_binding(name: str, url: str) -> None:
    """Raises BindingError for the first rule broken."""
    fault = lambda kind, why, **d: BindingError(kind, f"URL '{url}' {why}", url=url, **d)
    m = _AUTHORITY.match(url.strip())
    if not m:
        raise fault("Unparsable", "cannot be parsed")
    scheme, authority = m[1].lower(), m[2]
    if scheme != "https":
        raise fault("NonHttpsScheme", f"must use https, not {scheme}", scheme=scheme)
    if "@" in authority and authority.rpartition("@")[0] not in ("", ":"):
        raise fault("Userinfo", "must not contain userinfo")
    split = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", authority.rpartition("@")[2], re.DOTALL)
    if split is None:
        raise fault("Unparsable", "cannot be parsed")
    host, port = split.groups()
    if port and (not re.fullmatch("[0-9]+", port) or int(port) > 65535):
        raise fault("Unparsable", f"has no port number after its host: {port}")
    if not host.startswith("["):
        host = unquote(host)
        if re.search(_FORBIDDEN, host):
            raise fault("Unparsable", "has a host with a character that none may hold")
    host = to_ascii(host.rstrip("."))
    if host is None:
        raise fault("Unparsable", "has a host that is no domain name")
    if not host:
        raise fault("Unparsable", "has no host")
    if _is_address(host) or "." not in host:
        raise fault("NonDomainHost", "must have a domain name of two labels at least, and no address, for its host")
    prefix = reverse_labels(host)
    if not name.startswith(f"{prefix}."):
        raise BindingError("AuthorityMismatch", f"capability '{name}' is not under '{prefix}.', which the host of '{url}' asks for", name=name, url=url, host=host, expected_prefix=prefix)


def _is_address(host: str) -> bool:
    if re.fullmatch(r"(0x[0-9a-f]*|[0-9]+)", host.rpartition(".")[2]):  # a last label that is a number makes an address
        return True
    try:
        ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    return True


def binding_status_col(name: Column, url: Column) -> Column:
    """ok, or the kind of the first rule broken, as check_binding() tells it; hosts beyond ASCII become ASCII in the JVM, by UTS 46."""
    at = lambda i: F.regexp_extract(F.trim(url), _AUTHORITY.pattern, i)
    scheme, authority = F.lower(at(1)), at(2)
    user = F.regexp_extract(authority, r"^(.*)@[^@]*$", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    shape = r"(?s)^(\[[^\]]*\]|[^:]*)(?::(.*))?$"
    port, raw = F.regexp_extract(place, shape, 2), F.regexp_extract(place, shape, 1)
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    named = F.regexp_replace(F.when(raw.startswith("["), raw).otherwise(decoded), r"\.+$", "")
    host = F.when(named.rlike(r"[^\x00-\x7F]"), to_ascii_col(named)).otherwise(F.lower(named))
    bad_port = (port != "") & ~(port.rlike("^[0-9]+$") & port.try_cast("decimal(38,0)").between(0, 65535))
    return (
        F.when(url.isNull() | (scheme == ""), "Unparsable")
        .when(scheme != "https", "NonHttpsScheme")
        .when(~user.isin("", ":"), "Userinfo")
        .when(~place.rlike(shape) | F.coalesce(bad_port, F.lit(True)), "Unparsable")
        .when(~raw.startswith("[") & decoded.rlike(_FORBIDDEN), "Unparsable")
        .when((named == "") | host.isNull(), "Unparsable")
        .when(host.startswith("[") | host.rlike(r"(^|\.)(0x[0-9a-f]*|[0-9]+)$") | ~host.contains("."), "NonDomainHost")
        .when(name.startswith(F.concat(reverse_labels_col(host), F.lit("."))), "ok")
        .otherwise("AuthorityMismatch")
    )
