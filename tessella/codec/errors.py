"""What a reader raises for a file that breaks its format."""


class FormatError(ValueError):
    pass


def need(ok: bool, what: str) -> None:
    if not ok:
        raise FormatError(what)
