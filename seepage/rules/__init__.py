"""Rule data.

A rule is one regular expression plus what Spark needs to run it cheaply over
very large bodies.  Users add detectors by passing their own ``Rule`` lists.
"""

from __future__ import annotations

import re
from dataclasses import dataclass


# Tests on the lower-cased text, as patterns: a scheme separator, the name of a
# cloud provider's host, an AWS resource name.
GATES = {
    "scheme": "://",
    "host": (
        r"[.](?:s3|rds|compute|elb|execute-api|lambda|amazonaws|cloudfront|core[.]windows|azure|azurewebsites|azureedge"
        r"|database[.]windows|redis[.]cache|googleapis|cloudfunctions|appspot|digitaloceanspaces|ondigitalocean"
        r"|herokuapp|firebase|us-|eu-|ap-|sa-|europe-|asia-|cloudapp|west|east|northeurope|southeastasia)"
    ),
    "arn": "arn:aws:",
}


@dataclass(frozen=True)
class Rule:
    """One pattern.

    group    capture group that holds the reported text (0 = whole match)
    needles  lower-case literals; every match holds at least one of them, so a
             body without any of them is not searched
    gate     name of a test that many rules share and that is made once per
             text (see ``GATES``); every match passes it
    stop     expression that every match ends with; text behind its last
             occurrence cannot take part in a match
    fast     pattern with the same matches that backtracks less in Java
    opener   start of a rule whose failure at one place means failure at every
             later one up to the end of ``skip``, which is then skipped at once
             (a rule with one does not report empty texts)
    skip     what follows an opener that failed: by default the rest of the text
    tier     informational severity of the rule itself
    """

    rule_id: str
    label: str
    pattern: str
    group: int = 0
    needles: tuple[str, ...] = ()
    gate: str = ""
    stop: str = ""
    fast: str = ""
    opener: str = ""
    skip: str = "(?s:.*+)"
    tier: str = ""

    def __post_init__(self) -> None:
        if self.gate and self.gate not in GATES:
            raise ValueError(f"unknown gate: {self.gate}")

    def java(self, flags: str = "") -> str:
        pattern = self.fast or self.pattern
        if self.opener:
            # group 1, and with it every group of the rule, is empty where the second branch has skipped something
            pattern = f"({pattern})|{self.opener}{self.skip}"
        return java_pattern(pattern, flags)


_CLASS = re.compile(r"\\[wWsSdDbB]")


def java_pattern(pattern: str, flags: str = "") -> str:
    """Pattern text that gives java.util.regex the semantics of the rules.

    ``d`` makes ``\\n`` the only line end, ``u`` folds case beyond ASCII and
    ``U`` (only where a class or boundary occurs) makes ``\\w \\s \\d \\b``
    cover all of Unicode.
    """
    unicode_classes = "U" if _CLASS.search(pattern) else ""
    return f"(?du{unicode_classes}{flags}){pattern}"
