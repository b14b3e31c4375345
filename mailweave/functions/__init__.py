from . import emails, ids, text, urls  # noqa: F401
