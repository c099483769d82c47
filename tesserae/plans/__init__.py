"""Multi-operator jobs: manifest build, agent rounds, evaluation."""
