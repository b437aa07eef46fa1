"""The one exception raised for unusable input."""


class AnalysisError(ValueError):
    """Input that an operator cannot work on; ``code`` is stable and machine readable."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code
