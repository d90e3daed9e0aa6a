x665