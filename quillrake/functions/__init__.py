"""Part of quillrake."""
