"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character that is seen: no separator, control, format or unassigned character, none of the blank fillers.
SEEN = r"[^\p{Z}\p{C}ㅤ⠀ᅟᅠﾠ͏︀-️]"
#: The spellings of roles.
USER_ROLES, ASSISTANT_ROLES, OTHER_ROLES = ("user", "human"), ("assistant", "ai", "bot", "model"), ("system", "tool")


def is_seen(text: Column) -> Column:
    """Whether a text has a visible character; false for null."""
    return F.coalesce(text.rlike(SEEN), F.lit(False))


def strip_white(text: Column) -> Column:
    """The text without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def clean_role(role: Column) -> Column:
    """user, assistant, other (system and tool, which are no turns) or unknown; null roles are unknown."""
    name = F.lower(strip_white(role))
    return F.when(name.isin(*USER_ROLES), "user").when(name.isin(*ASSISTANT_ROLES), "assistant").when(name.isin(*OTHER_ROLES), "other").otherwise("unknown")
