"""Operations for preparing training data.

Nothing else in the library imports this subpackage; it can be removed as a
whole.  Each module holds one operator as ``DataFrame -> DataFrame``; the
registered queries with their production parameters are in ``queries``.
"""
