"""Where turn logs and attributes come from, and where layers are written."""
