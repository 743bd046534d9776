"""Rules over syntax trees, declared as conditions on the columns of `nodes`."""

import dataclasses
from collections import Counter

from sleuthframe.rules import alignment, layout, lint, lint_more, naming, rest, security, style, style_more
from sleuthframe.rules.edits import EDITS
from sleuthframe.rules.policy import POLICY, STYLES

_DECLARED = (*layout.RULES, *lint.RULES, *lint_more.RULES, *security.RULES, *style.RULES, *style_more.RULES, *naming.RULES, *rest.RULES, *alignment.RULES)


def _with_edits(rules: tuple) -> tuple:
    """The rules with their edits, which are told by name and order of declaration."""
    seen: Counter = Counter()
    out = []
    for r in rules:
        told = EDITS.get(r.name)
        mine = (told[seen[r.name]] if seen[r.name] < len(told) else None) if isinstance(told, tuple) else told
        seen[r.name] += 1
        out.append(dataclasses.replace(r, edits=mine) if mine is not None else r)
    return tuple(out)


def _with_policy(rules: tuple, styles: tuple) -> tuple:
    """The rules with what configuration may change, and their other styles."""
    asked = [dataclasses.replace(r, options={**POLICY[r.name][0], **r.options}, only=POLICY[r.name][1]) if r.name in POLICY else r for r in rules]
    return (*asked, *(dataclasses.replace(r, options={**POLICY.get(r.name, ({}, ""))[0], **r.options}) for r in styles))


RULES = _with_policy(_with_edits(_DECLARED), STYLES)
