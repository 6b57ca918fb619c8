"""What can be wrong with inputs."""


class GranuloError(Exception):
    """Base of all errors of this package."""


class SettingsError(GranuloError):
    """Settings lack a key, hold one too many, or a value of the wrong type."""


class LayoutError(GranuloError):
    """A working directory doesn't hold what its settings name."""


class SeveralFilesError(LayoutError):
    """Several files fit where one is asked for."""


class ParticleCsvError(GranuloError):
    """A particle file's columns fit no known layout, or several."""


class EmptySourceError(GranuloError):
    """There are no particles to work on, or no scale for them."""


class StateError(GranuloError):
    """A step was called out of order."""


class UnknownIdError(GranuloError):
    """A particle that is asked for by its ID isn't there."""


class AgglomerateError(GranuloError):
    """An agglomerate without members, or a member that isn't one."""
