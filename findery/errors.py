"""What can go wrong, and in which of seven ways a caller has to take it."""

from __future__ import annotations

from enum import StrEnum


class ErrorCategory(StrEnum):
    REFUSED = "refused"
    NOT_FOUND = "not_found"
    UNSUPPORTED = "unsupported"
    CORRUPT = "corrupt"
    STORAGE = "storage"
    CONFLICT = "conflict"
    RECOVERY_REQUIRED = "recovery_required"


class FinderyError(Exception):
    category: ErrorCategory = ErrorCategory.REFUSED


def _kind(name: str, category: ErrorCategory, doc: str) -> type[FinderyError]:
    return type(name, (FinderyError,), {"category": category, "__doc__": doc, "__module__": __name__})


_R, _C = ErrorCategory.REFUSED, ErrorCategory.CORRUPT
DimensionMismatch = _kind("DimensionMismatch", _R, "A vector has another length than the index.")
InvalidVector = _kind("InvalidVector", _R, "A vector holds a null or a component that isn't finite.")
DistanceNotRepresentable = _kind("DistanceNotRepresentable", _R, "A finite distance has no 32-bit value.")
InvalidHnswConfig = _kind("InvalidHnswConfig", _R, "A vector index setting is zero.")
InvalidKConstant = _kind("InvalidKConstant", _R, "The fusion constant isn't finite and positive.")
InvalidIdentifier = _kind("InvalidIdentifier", _R, "A name, key, version or member id is off its grammar.")
FamilyMismatch = _kind("FamilyMismatch", _R, "Text where vectors are kept, or the other way round.")
DuplicateMember = _kind("DuplicateMember", _R, "A batch names a member twice.")
EmptyBatch = _kind("EmptyBatch", _R, "An insert or remove without members.")
TransitionNotPermitted = _kind("TransitionNotPermitted", _R, "The index's state doesn't allow the operation.")
RecordMismatch = _kind("RecordMismatch", _R, "A record of another index than the operation's.")
UnencodableOperation = _kind("UnencodableOperation", _R, "A value has no canonical form.")
WriterHeld = _kind("WriterHeld", _R, "This thread already holds the store's writer.")
IndexNotFound = _kind("IndexNotFound", ErrorCategory.NOT_FOUND, "No such index, or a destroyed one.")
NotYetImplemented = _kind("NotYetImplemented", ErrorCategory.UNSUPPORTED, "An analyzer other than the simple one.")
UnsupportedSnapshotVersion = _kind("UnsupportedSnapshotVersion", ErrorCategory.UNSUPPORTED, "A newer or unknown format.")
SnapshotFormat = _kind("SnapshotFormat", _C, "A snapshot of the other family.")
CorruptSnapshot = _kind("CorruptSnapshot", _C, "Stored data that contradicts itself.")
VersionStored = _kind("VersionStored", _C, "The version to stage is already stored.")
Persistence = _kind("Persistence", ErrorCategory.STORAGE, "The storage failed.")
HeadChanged = _kind("HeadChanged", ErrorCategory.CONFLICT, "Another writer moved the index meanwhile.")
OperationConflict = _kind("OperationConflict", ErrorCategory.CONFLICT, "The key was used for another operation.")
StagedStateMissing = _kind("StagedStateMissing", ErrorCategory.CONFLICT, "What was staged is gone or altered.")
OperationRecorded = _kind("OperationRecorded", ErrorCategory.CONFLICT, "The key is already recorded.")
StagedStateExists = _kind("StagedStateExists", ErrorCategory.RECOVERY_REQUIRED, "An unfinished operation blocks the index.")

VARIANTS = tuple(x for x in list(globals().values()) if isinstance(x, type) and issubclass(x, FinderyError) and x is not FinderyError)
