x248