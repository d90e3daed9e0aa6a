x613