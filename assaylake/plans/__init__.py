"""Reports, standard questions and the whole workflow."""
