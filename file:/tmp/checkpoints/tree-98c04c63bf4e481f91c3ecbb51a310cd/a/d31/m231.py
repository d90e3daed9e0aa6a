x231