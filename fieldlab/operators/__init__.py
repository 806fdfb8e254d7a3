"""DataFrame operators on fields, reactions, meshes, matrices and configurations."""
