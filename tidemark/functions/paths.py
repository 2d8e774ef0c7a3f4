"""Object keys and locations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SCHEME = "s3"
SNAPSHOT_PATTERN = r"snapshot\.(.*?)/"
DIRECTORY_TYPE = "application/x-directory"
BLANKS = "".join(chr(code) for code in range(33))  # the space and everything before it

EMPTY_KEY = "empty key"
EMPTY_LOCATION = "empty location"


def trimmed(text: Column) -> Column:
    """Without blanks and control characters at either end."""
    return F.btrim(text, F.lit(BLANKS))


def path_key(raw: Column) -> Column:
    """Trimmed, and without one leading slash."""
    return trimmed(F.regexp_replace(trimmed(raw), "^/", ""))


def file_of(path: Column) -> Column:
    """A path key without one trailing slash; empty if nothing is left (which is an error)."""
    return trimmed(F.regexp_replace(path, "/$", ""))


def dir_of(path: Column) -> Column:
    """A path key that ends with a slash; the root is ``/``."""
    return F.concat(F.regexp_replace(path, "/$", ""), F.lit("/"))


def parent_key(key: Column) -> Column:
    """Directory above a key: empty without any slash, ``/`` if only the root is left.

    A slash at the end of the key does not count as a separator.
    """
    bare = F.regexp_replace(key, "/$", "")
    above = F.regexp_extract(bare, "^(.*/)[^/]*$", 1)
    return F.when(~key.contains("/"), "").when(F.length(bare) <= 1, "/").otherwise(above)


def location_text(location: Column) -> Column:
    """A location as URI text: rooted unless it already is or names the scheme, ending in a slash.

    Null for an empty location, which is an error.
    """
    named = location.startswith(f"{SCHEME}:")
    rooted = F.when(location.startswith("/") | named, location).otherwise(F.concat(F.lit("/"), location))
    return F.when(location != "", F.concat(F.regexp_replace(rooted, "/$", ""), F.lit("/")))


def uri_host(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"^{SCHEME}://([^/]*)/", 1), F.lit(""))


def uri_path(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SCHEME}:(//[^/]*)?", "")


def without_dots(segments: Column) -> Column:
    """Path segments with ``.`` dropped and ``..`` taking the segment before it away."""
    nothing = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        return (
            F.when((part == ".") | (part == ""), done)
            .when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.aggregate(segments, nothing, step)


def resolve_key(base_path: Column, *components: Column) -> Column:
    """Components below a base path, with repeated slashes and dots normalised."""
    joined = F.concat_ws("/", base_path, *components)
    parts = without_dots(F.split(joined, "/"))
    lead = F.when(joined.startswith("/"), "/").otherwise("")
    climbed = joined.rlike(r"/\.\.$") & (F.get(parts, F.size(parts) - 1) != "..")
    trail = F.when((F.size(parts) > 0) & (joined.rlike(r"(/|/\.)$") | climbed), "/").otherwise("")
    return F.concat(lead, F.array_join(parts, "/"), trail)


def resolve_directory(base_path: Column, *components: Column) -> Column:
    """The same, always ending in a slash."""
    return resolve_key(base_path, *components, F.lit(""))


def snapshot_name(key: Column) -> Column:
    """Name of the snapshot a key belongs to, null if it belongs to none."""
    return F.nullif(F.regexp_extract(key, SNAPSHOT_PATTERN, 1), F.lit(""))


def ancestors(key: Column) -> Column:
    """All directories above a key, each with its trailing slash, outermost first."""
    bare = F.regexp_replace(key, "/$", "")
    parts = F.split(bare, "/")
    levels = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(levels, lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
