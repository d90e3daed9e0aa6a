x897