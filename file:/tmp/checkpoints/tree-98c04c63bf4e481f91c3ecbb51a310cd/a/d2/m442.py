x442