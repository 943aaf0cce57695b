"""The small language in which operators are told their features.

`...` is every feature; a FeatureType every feature of that type; (type, name) one feature; (type, old, new) one feature and
its new name; (type, ...) every feature of the type; {type: [names or (old, new) pairs] or ...}; and sequences of all these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from geoloom.types import FeatureType, MissingFeatureError

Triple = tuple[FeatureType, str | None, str | None]
FORBIDDEN = set("./\\|;:\n\t")


def check_name(name: object) -> str:
    if not isinstance(name, str) or not name or FORBIDDEN & set(name):
        raise ValueError(f"not a name for a feature: {name!r}")
    return name


def as_type(kind: object) -> FeatureType:
    try:
        return kind if isinstance(kind, FeatureType) else FeatureType(kind)
    except ValueError:
        raise ValueError(f"not a feature type: {kind!r}") from None


class Spec:
    """A parsed specification; resolve() binds it to the features at hand."""

    def __init__(self, features: object, allowed: Iterable[FeatureType] | Callable[[FeatureType], bool] | None = None):
        self.allowed = allowed if callable(allowed) else (set(allowed) if allowed is not None else set(FeatureType)).__contains__
        self.everything = features is ...
        self.triples: list[Triple] = [] if self.everything else list(self._parse(features))
        for kind, _, _ in self.triples:
            if not self.allowed(kind):
                raise ValueError(f"{kind} is not allowed here")

    def _parse(self, item: object) -> Iterable[Triple]:
        if isinstance(item, (FeatureType, str)):
            yield as_type(item), None, None
        elif isinstance(item, dict):
            for kind, names in item.items():
                for name in [...] if names is ... else names:
                    yield self._named(as_type(kind), *(name if isinstance(name, tuple) else (name,)))
        elif isinstance(item, tuple) and item and (isinstance(item[0], FeatureType) or isinstance(item[0], str) and item[0] in {t.value for t in FeatureType}) and len(item) in (2, 3) and (item[1] is ... or isinstance(item[1], str)):
            yield self._named(as_type(item[0]), *item[1:])
        elif isinstance(item, (list, tuple, set)):
            for part in item:
                yield from self._parse(part)
        else:
            raise ValueError(f"can't read a feature from {item!r}")

    @staticmethod
    def _named(kind: FeatureType, old: object, new: object = None) -> Triple:
        if old is ...:
            return kind, None, None
        return kind, check_name(old), check_name(new) if new is not None else check_name(old)

    def resolve(self, have: Iterable[tuple[FeatureType, str]] | None = None) -> list[tuple[FeatureType, str, str]]:
        """(type, name, new name) of every feature meant. Without `have` all must be named."""
        have = None if have is None else list(have)
        if self.everything:
            if have is None:
                raise ValueError("`...` needs a patch set")
            return [(k, n, n) for k, n in have if self.allowed(k)]
        out = []
        for kind, old, new in self.triples:
            if old is None:
                if have is None:
                    raise ValueError(f"all features of {kind} need a patch set")
                out += [(k, n, n) for k, n in have if k is kind]
            else:
                if have is not None and (kind, old) not in have:
                    raise MissingFeatureError(f"no feature {(kind, old)}")
                out.append((kind, old, new))
        return out

    def features(self, have: Iterable[tuple[FeatureType, str]] | None = None) -> list[tuple[FeatureType, str]]:
        return [(k, old) for k, old, _ in self.resolve(have)]


def one_feature(feature: object, have: Iterable[tuple[FeatureType, str]] | None = None) -> tuple[FeatureType, str, str]:
    found = Spec(feature).resolve(have)
    if len(found) != 1:
        raise ValueError(f"one feature is wanted, not {len(found)}")
    return found[0]
