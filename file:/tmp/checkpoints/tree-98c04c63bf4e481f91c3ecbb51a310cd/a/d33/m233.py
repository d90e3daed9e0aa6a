x233