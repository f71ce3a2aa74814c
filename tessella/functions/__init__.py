"""Column functions: fixed rules, classification, text measures, diagrams and code parsing."""
