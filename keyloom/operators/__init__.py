"""The relational algebra over keyed relations."""

from .relation import Relation, U
from .restriction import AndList, Not, Top

__all__ = ["AndList", "Not", "Relation", "Top", "U"]
