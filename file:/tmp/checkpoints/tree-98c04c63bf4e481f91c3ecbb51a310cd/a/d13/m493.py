x493