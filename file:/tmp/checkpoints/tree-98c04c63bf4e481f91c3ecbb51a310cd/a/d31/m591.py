x591