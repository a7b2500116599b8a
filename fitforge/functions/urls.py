"""Which posting of which board an address means."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitforge.functions.postings import let, stripped

# scheme, host without user or port, path
_ADDRESS = r"^(?i:https?)://([A-Za-z0-9.-]+)(/[^?#\s\\]*)?(?:[?#]\S*)?$"


@dataclass(frozen=True)
class Board:
    """A board's name, its hosts and its paths: whole patterns, the path's groups are token and identifier."""

    name: str
    host: str
    path: str
    lower_id: bool = False


def posting_reference(url: Column, boards: list[Board]) -> Column:
    """board, token and external_id of the posting that ``url`` means, or null.

    Only http and https; an address with a user, a password or a port is refused, as is
    any host or path that is not wholly a board's, so that none leads elsewhere.  Blanks
    around it, queries and fragments do not matter; hosts and tokens are in lower case.
    """

    def of(bare: Column) -> Column:
        host, path = F.lower(F.regexp_extract(bare, _ADDRESS, 1)), F.coalesce(F.regexp_extract(bare, _ADDRESS, 2), F.lit(""))
        found = F.lit(None).cast("struct<board:string,token:string,external_id:string>")
        for b in reversed(boards):
            pattern = rf"^{b.path}$"
            external = F.regexp_extract(path, pattern, 2)
            own = F.struct(F.lit(b.name).alias("board"), F.lower(F.regexp_extract(path, pattern, 1)).alias("token"), (F.lower(external) if b.lower_id else external).alias("external_id"))
            found = F.when(host.rlike(rf"^(?:{b.host})$") & path.rlike(pattern), own).otherwise(found)
        return F.when(bare.rlike(_ADDRESS), found)

    return let(stripped(url), of)
