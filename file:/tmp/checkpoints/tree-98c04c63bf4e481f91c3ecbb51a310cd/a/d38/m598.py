x598