"""Files of frames."""
