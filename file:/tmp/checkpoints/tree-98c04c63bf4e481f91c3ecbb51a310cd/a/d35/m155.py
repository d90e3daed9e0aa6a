x155