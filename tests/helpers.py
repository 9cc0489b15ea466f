"""Shared by the tests."""


def canonical(frame):
    """Rows of a pandas frame in an order of their own, columns by name."""
    frame = frame[sorted(frame.columns)]
    plain = [[None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in row] for row in frame.astype(object).itertuples(index=False, name=None)]
    return sorted(map(repr, plain))
