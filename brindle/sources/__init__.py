"""Tables, snapshot manifests and the shared work folder."""
