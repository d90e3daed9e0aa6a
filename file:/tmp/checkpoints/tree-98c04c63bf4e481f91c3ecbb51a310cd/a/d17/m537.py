x537